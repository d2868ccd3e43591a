"""Scoring of extracted documents against ground truth, as Spark DataFrame queries."""
