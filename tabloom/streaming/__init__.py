"""Scoring of rows as they arrive."""
