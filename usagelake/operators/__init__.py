"""Relational operators over facts, evidence and their graphs."""
