"""Spark-first analytics over typed property graphs: build, embed, rank, test."""
