"""Contingency-table analytics on Spark: encode, count, combine, estimate, answer, synthesize."""
