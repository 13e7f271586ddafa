"""Whole comparisons and their reports."""
