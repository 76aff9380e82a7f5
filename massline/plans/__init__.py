"""Registered queries: a DataFrame plan and its SQL text."""
