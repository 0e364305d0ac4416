"""Tidewell sinks."""
