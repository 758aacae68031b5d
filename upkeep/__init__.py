"""Batch and streaming jobs for industrial maintenance data, on PySpark."""
