"""Trajectory intent analytics as Spark jobs."""
