"""Household-panel analytics as Spark DataFrame transforms."""
