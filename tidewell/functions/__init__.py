"""Tidewell functions."""
