"""Joins, matches and groups by hash distance."""
