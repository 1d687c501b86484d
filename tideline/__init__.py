"""Tideline: keyed line streams and the analytics around them, as PySpark DataFrame operators."""
