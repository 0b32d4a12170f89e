"""Streaming of the change-detection engine."""
