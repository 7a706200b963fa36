"""Tracewright: digitised line charts to calibrated series, as Spark DataFrame transformations."""
