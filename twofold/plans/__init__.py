"""Configured runs, and the driver's queries with their SQL."""
