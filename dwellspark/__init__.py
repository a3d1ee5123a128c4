"""Spark jobs on trajectories, state changes and waiting times."""
