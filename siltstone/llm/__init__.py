"""Operators for preparing text and code as training data."""
