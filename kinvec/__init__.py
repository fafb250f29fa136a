"""Spark-first analytics over labelled embedding vectors."""
