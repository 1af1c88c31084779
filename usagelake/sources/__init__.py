"""Readers of native session records."""
