"""Operators of the listings engine."""
