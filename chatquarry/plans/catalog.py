"""All queries by name, each with the DuckDB SQL that gives the same rows."""

from . import files, chats, curation, extraction, helpers, monitoring, scoring, sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
