"""Spark-first operators for checking machine-read texts against reference texts."""
