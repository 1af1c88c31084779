"""Queries as values: defaults, validation, periods, and what the viewers show."""
