"""Composed plans, the query registry and its oracle SQL."""
