"""All queries of the reference's own operators."""

from . import analytics, changes, chunking, dictionary, exported, files, lifecycle, lists, outlines, parsing, predicates, relational, retrieval, review, reviewing, saves, streams, textual, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
