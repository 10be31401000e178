"""Territorial indicators as Spark jobs, for many projects at once."""
