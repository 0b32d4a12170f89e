"""Sources of the change-detection engine."""
