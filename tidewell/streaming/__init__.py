"""Tidewell streaming."""
