"""Queries by name and whole runs."""
