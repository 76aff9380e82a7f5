"""Operators on token, segment, boundary and interval tables."""
