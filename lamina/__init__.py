"""Layered, incremental analytics expressed as Spark DataFrame plans."""
