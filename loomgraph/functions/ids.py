"""Record ids as people and programs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS_AND_BRACES = " \t\n\v\f\r{}"


def normal_id(c: Column) -> Column:
    """An id without letter case, braces and outer blanks; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(c, F.lit(_BLANKS_AND_BRACES))), F.lit(""))


def id_key(c: Column) -> Column:
    """A normal id as bytes, for shuffling: 16 bytes for a UUID, else its text behind 16 zero bytes.

    Two keys are equal exactly if the normal ids are; the other form is longer than 16 bytes.
    """
    n = normal_id(c)
    uuid = (F.length(n) == 36) & n.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(uuid, F.unhex(F.replace(n, F.lit("-"), F.lit("")))).otherwise(
        F.concat(F.unhex(F.lit("00" * 16)), F.encode(n, "utf-8"))
    )
