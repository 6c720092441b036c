"""Imports every module that registers queries."""

from pitline.plans import books, decisions, measures, reads, scans, sessions, streams  # noqa: F401
from pitline.plans.registry import QUERIES, SQL  # noqa: F401
