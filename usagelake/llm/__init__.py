"""Operators for preparing training data: one module for each, plus the queries that apply them to whole tables."""
