"""Operators for preparing training text and vectors, and their queries."""
