"""Density scans of integer vectors, expressed as PySpark DataFrame plans."""
