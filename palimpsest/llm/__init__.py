"""Operators that prepare training data; nothing outside this package imports it."""
