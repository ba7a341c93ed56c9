"""Spark-first analytics over columnar sequence records, and training-data operators on text."""
