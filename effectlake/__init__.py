"""Causal effect estimation as Spark jobs."""
