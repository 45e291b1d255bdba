"""Readers: framed dump logs, exported points, peak tables."""
