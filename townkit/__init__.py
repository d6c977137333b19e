"""Listings analytics as Spark jobs: sources, functions, operators, plans and streaming."""
