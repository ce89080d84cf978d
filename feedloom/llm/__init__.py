"""Operators for preparing training data (see ``queries.py`` for the list)."""
