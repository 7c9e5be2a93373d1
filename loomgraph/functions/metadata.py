"""Metadata columns: JSON kept as text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def dumps(value: dict | None) -> str:
    """JSON of a mapping; '{}' for None. Anything else is an error."""
    if value is None:
        return "{}"
    if not isinstance(value, dict):
        raise TypeError(f"metadata must be a mapping, not {type(value).__name__}")
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def loads(text: str | bytes | None) -> dict:
    """The mapping of a JSON text; {} for None, 'null' or nothing. Text that is no mapping is an error."""
    value = json.loads(text) if text else {}
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise TypeError("metadata is no mapping")
    return value


def field(c: Column, name: str) -> Column:
    """A field of a metadata column as text; null if the text is cut off or lacks it."""
    return F.get_json_object(c, f"$.{name}")
