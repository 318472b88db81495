"""Palimpsest: a Spark-first engine for finding, making and scoring copied regions."""
