"""Operators that prepare note collections as training text."""
