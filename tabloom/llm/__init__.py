"""Operators for building training data from a text corpus, one module each, and their queries."""
