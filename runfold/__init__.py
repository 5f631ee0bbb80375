"""Durable-execution journals as Spark relations."""
