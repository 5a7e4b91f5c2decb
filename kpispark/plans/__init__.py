"""Registered query plans and their SQL oracles."""

from . import linear_queries  # noqa: F401
from .catalog import ORACLE, QUERIES  # noqa: F401
