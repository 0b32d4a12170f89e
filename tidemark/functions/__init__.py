"""Functions of the change-detection engine."""
