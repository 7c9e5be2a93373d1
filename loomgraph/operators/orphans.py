"""References to records that do not exist.

Distinct non-null foreign keys, with the earliest reference to each, are combined before the shuffle and anti-joined
with the parents that are there; what is left, and what may be there too late, is joined back to the references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import id_key
from loomgraph.operators.skew import fragment_replicate_join
from loomgraph.runtime import cut, small

#: Endpoint columns of edges and the kind of record that each refers to.
ENDPOINTS = {"source_chunk_id": "chunk", "target_chunk_id": "chunk", "source_entity_id": "entity", "target_entity_id": "entity"}
#: Bad keys are broadcast up to this many rows of about 40 bytes. With more, references are joined in shards, as one
#: missing parent may be referred to by a large share of them.
BROADCAST_ROWS = 200_000


def parents(chunks: DataFrame, entities: DataFrame, deletions: DataFrame) -> DataFrame:
    """(kind, key, first_at, stands): the records that stand, with their oldest created_at.

    A record counts as deleted if it is logged under its kind with deleted_at after the newest created_at of its
    rows. A record whose rows all lack created_at is never deleted or late by comparison with null.
    """
    rows = [t.select(F.lit(kind).alias("kind"), id_key(F.col("id")).alias("key"), "created_at") for t, kind in ((chunks, "chunk"), (entities, "entity"))]
    there = rows[0].unionByName(rows[1]).filter("key IS NOT NULL").groupBy("kind", "key").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    gone = (
        deletions.select(F.lower(F.trim("record_kind")).alias("kind"), id_key(F.col("record_id")).alias("key"), "deleted_at")
        .filter("key IS NOT NULL")
        .groupBy("kind", "key")
        .agg(F.max("deleted_at").alias("deleted_at"))
    )
    kept = there.join(gone, ["kind", "key"], "left").filter(~F.coalesce(F.col("deleted_at") > F.col("last_at"), F.lit(False)))
    return kept.select("kind", "key", "first_at", F.lit(True).alias("stands"))


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, created_at, ref_column, kind, key): one row per endpoint that is neither null nor blank."""
    ends = F.array(*[F.struct(F.lit(c).alias("ref_column"), F.lit(kind).alias("kind"), id_key(F.col(c)).alias("key")) for c, kind in ENDPOINTS.items()])
    return edges.select(F.col("id").alias("edge_id"), "created_at", F.explode(F.filter(ends, lambda x: x["key"].isNotNull())).alias("e")).select("edge_id", "created_at", "e.*")


def orphans(edges: DataFrame, chunks: DataFrame, entities: DataFrame, deletions: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(edge_id, created_at, ref_column): the references to records never there, deleted, or created after the edge.

    Ids are compared without letter case, braces and outer blanks. Edges without created_at are never early. A row
    for each row of ``edges``: rows delivered twice give two. Empty tables of parents make every reference an
    orphan; empty ``edges`` give none. Further columns of the tables are ignored.
    """
    refs = references(edges)
    keys = refs.groupBy("kind", "key").agg(F.min("created_at").alias("earliest"))
    known = parents(chunks, entities, deletions)
    # one join tells keys without a standing parent from keys whose parent is younger than some reference
    missing = keys.join(known, ["kind", "key"], "left")
    bad = cut(missing.filter(F.col("stands").isNull() | (F.col("earliest") < F.col("first_at"))).select("kind", "key", "first_at", "stands"))
    found = refs.join(F.broadcast(bad), ["kind", "key"]) if small(bad, broadcast_rows) else fragment_replicate_join(refs, bad, ["kind", "key"], by=["edge_id", "ref_column"])
    late = F.col("stands").isNull() | (F.col("created_at") < F.col("first_at"))
    return found.filter(late).select("edge_id", "created_at", "ref_column")
