"""Transcript and parallel-text analytics as Spark plans."""
