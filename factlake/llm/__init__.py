"""Operators for preparing training data; see queries.py for one query each."""
