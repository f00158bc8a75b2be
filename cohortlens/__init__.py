"""Evaluation of record-level classifiers as Spark DataFrame jobs."""
