"""Composed plans and the registry of runnable queries."""
