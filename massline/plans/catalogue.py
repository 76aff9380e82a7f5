"""All registered queries."""

from . import annotations, documents, events, markup, relations, transcripts  # noqa: F401
from .registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
