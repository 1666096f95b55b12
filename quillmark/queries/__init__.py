"""Registry of the engine's own queries and the SQL that each is compared with."""

from __future__ import annotations

from quillmark.queries.registry import ORACLE_SQL, QUERIES
from quillmark.queries import evaluation, fusion, models, overlap, relations, storage, studies, text, vocabulary  # noqa: F401, I001  (they register)

__all__ = ["ORACLE_SQL", "QUERIES"]
