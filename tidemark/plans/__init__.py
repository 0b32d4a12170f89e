"""Plans of the change-detection engine."""
