"""Queries over the graphs of the driver's tables, and their oracle SQL."""
