"""Operators of the change-detection engine."""
