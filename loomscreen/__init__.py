"""Spark-first analytics for pooled perturbation screens."""
