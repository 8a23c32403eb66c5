"""Connectivity-telemetry analytics on PySpark.

The library is a set of ``DataFrame -> DataFrame`` operators over one table of
probe events, plus the batch and streaming jobs that fill that table.
"""
