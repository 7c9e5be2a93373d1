"""Text helpers with the semantics of the ingestion pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_ilike(c: Column, term: str) -> Column:
    """Case-insensitive search; ``%`` and ``_`` in the term act as wildcards."""
    return c.ilike(f"%{term}%")
