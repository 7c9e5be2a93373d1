"""Edges: insert, select by endpoint, delete, change of weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EDGE_TYPES



def edge_order(time: str = "created_at") -> list:
    return [F.desc_nulls_first("weight"), F.asc_nulls_last(time), F.asc_nulls_last("id")]


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``new`` appended. A row without source or target, or of an unknown type, is an error."""
    ok = F.coalesce("source_chunk_id", "source_entity_id").isNotNull() & F.coalesce("target_chunk_id", "target_entity_id").isNotNull()
    if new.filter(~ok).limit(1).count():
        raise ValueError("an edge needs a source and a target")
    if new.filter(~F.coalesce(F.col("edge_type").isin(*EDGE_TYPES), F.lit(False))).limit(1).count():
        raise ValueError(f"an edge type is none of {', '.join(EDGE_TYPES)}")
    return edges.unionByName(new.select(edges.columns))


def select_edge(edges: DataFrame, id_: str) -> DataFrame:
    return edges.filter(F.col("id") == id_)


def _at(edges: DataFrame, column: str, value: str, edge_type: str | None) -> DataFrame:
    hit = edges.filter(F.col(column) == value)
    return hit if edge_type is None else hit.filter(F.col("edge_type") == edge_type)


def edges_from_chunk(edges: DataFrame, chunk: str, edge_type: str | None = None, time: str = "created_at") -> DataFrame:
    return _at(edges, "source_chunk_id", chunk, edge_type).orderBy(*edge_order(time))


def edges_to_chunk(edges: DataFrame, chunk: str, edge_type: str | None = None, time: str = "created_at") -> DataFrame:
    return _at(edges, "target_chunk_id", chunk, edge_type).orderBy(*edge_order(time))


def edges_connected_to_chunk(edges: DataFrame, chunk: str, edge_type: str | None = None, time: str = "created_at") -> DataFrame:
    """Outgoing edges (is_outgoing), and incoming ones that are bidirectional; a bidirectional loop comes twice."""
    out = _at(edges, "source_chunk_id", chunk, edge_type).withColumn("is_outgoing", F.lit(True))
    into = _at(edges, "target_chunk_id", chunk, edge_type).filter("bidirectional").withColumn("is_outgoing", F.lit(False))
    return out.unionAll(into).orderBy(*edge_order(time))


def edges_from_entity(edges: DataFrame, entity: str, edge_type: str | None = None, time: str = "created_at") -> DataFrame:
    return _at(edges, "source_entity_id", entity, edge_type).orderBy(*edge_order(time))


def edges_to_entity(edges: DataFrame, entity: str, edge_type: str | None = None, time: str = "created_at") -> DataFrame:
    return _at(edges, "target_entity_id", entity, edge_type).orderBy(*edge_order(time))


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_anti").select(edges.columns)


def update_edge_weights(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Weights of the ids in ``changes`` (id, weight) replaced; ids that aren't there do nothing."""
    c = changes.select("id", F.col("weight").alias("_w"), F.lit(1).alias("_hit"))
    new = F.when(F.col("_hit").isNotNull(), F.col("_w")).otherwise(F.col("weight")).alias("weight")
    return edges.join(c, "id", "left").select(*[new if x == "weight" else x for x in edges.columns])
