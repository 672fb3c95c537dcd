"""Every query of the library by name, with its oracle SQL."""

from __future__ import annotations

from . import corpus, evaluation, lyrics, sequences, timelines  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
