"""Registered queries and whole runs."""

from . import more, queries  # noqa: F401
