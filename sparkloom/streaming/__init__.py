"""Measures over streams of events."""
