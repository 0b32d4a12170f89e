"""Change detection and tamper-evident history over versioned references, on PySpark."""
