"""Dotted label paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels(path: Column) -> Column:
    """The labels of a path; ordering by this array is the label-wise order."""
    return F.split(path, "[.]")


def nlevel(path: Column) -> Column:
    return F.size(labels(path))


def parent(path: Column) -> Column:
    """The path without its last label, '' for a root."""
    return F.regexp_replace(path, r"\.?[^.]*$", "")


def prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself."""
    a = labels(path)
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, F.lit(1), i), "."))


def literal_prefixes(path: str) -> list[str]:
    a = path.split(".")
    return [".".join(a[:i]) for i in range(1, len(a) + 1)]
