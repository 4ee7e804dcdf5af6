"""Spark-first analytics for physical-infrastructure audits."""
