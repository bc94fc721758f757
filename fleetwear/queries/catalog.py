"""Importing this module registers every query."""

from fleetwear.queries import files, modelling, prep, relational  # noqa: F401
