"""Operators on document texts."""
