"""Evaluation analytics expressed as Spark DataFrame plans."""
