"""Entities: upsert, look up, search, delete, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import contains_ilike


def upsert_entities(entities: DataFrame, new: DataFrame, arrival: str = "created_at") -> DataFrame:
    """Entities with ``new`` (id, name, entity_type, metadata, created_at) merged on name and type.

    A known pair keeps id and created_at and takes the metadata of the last new row by ``arrival`` (ties: larger id);
    an unknown pair takes id and created_at of its first new row. Rows of ``entities`` are taken as unique by pair.
    """
    order = F.struct(F.col(arrival), F.col("id"))
    batch = new.filter("name IS NOT NULL AND entity_type IS NOT NULL").groupBy("name", "entity_type").agg(
        F.max_by("metadata", order).alias("_m"), F.min(F.struct(F.col(arrival).alias("a"), "id", "created_at")).alias("_f"), F.count("*").alias("_hit")
    )
    j = entities.join(batch, ["name", "entity_type"], "full_outer")
    return j.select(
        F.coalesce("id", "_f.id").alias("id"), "name", "entity_type", F.when(F.col("_hit").isNotNull(), F.col("_m")).otherwise(F.col("metadata")).alias("metadata"),
        F.when(F.col("id").isNotNull(), F.col("created_at")).otherwise(F.col("_f.created_at")).alias("created_at"),
    )


def select_entity(entities: DataFrame, id_: str) -> DataFrame:
    return entities.filter(F.col("id") == id_)


def select_entity_by_name(entities: DataFrame, name: str, entity_type: str) -> DataFrame:
    return entities.filter((F.col("name") == name) & (F.col("entity_type") == entity_type))


def search_entities(entities: DataFrame, term: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
    hit = entities.filter(contains_ilike(F.col("name"), term))
    if entity_type is not None:
        hit = hit.filter(F.col("entity_type") == entity_type)
    return hit.orderBy("name", "id").limit(limit)


def select_entities_by_type(entities: DataFrame, entity_type: str, limit: int = 100) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type).orderBy("name", "id").limit(limit)


def delete_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id"), "id", "left_anti").select(entities.columns)


def update_entity_metadata(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata of the ids in ``changes`` (id, metadata) replaced."""
    c = changes.select("id", F.col("metadata").alias("_m"), F.lit(1).alias("_hit"))
    replaced: Column = F.when(F.col("_hit").isNotNull(), F.col("_m")).otherwise(F.col("metadata")).alias("metadata")
    return entities.join(c, "id", "left").select(*[replaced if x == "metadata" else x for x in entities.columns])


def chunks_mentioning(edges: DataFrame, entity: str) -> DataFrame:
    """(chunk_id, edge_id, edge_metadata): mentions of an entity, newest first."""
    hit = edges.filter((F.col("target_entity_id") == entity) & (F.col("edge_type") == "entity_mention") & F.col("source_chunk_id").isNotNull())
    return hit.orderBy(F.desc_nulls_first("created_at"), "id").select(F.col("source_chunk_id").alias("chunk_id"), F.col("id").alias("edge_id"), F.col("metadata").alias("edge_metadata"))


def chunk_ids_for(edges: DataFrame, entity: str) -> DataFrame:
    """(id): chunks at the other end of any edge of an entity, in either direction, once."""
    out = edges.filter((F.col("source_entity_id") == entity) & F.col("target_chunk_id").isNotNull()).select(F.col("target_chunk_id").alias("id"))
    back = edges.filter((F.col("target_entity_id") == entity) & F.col("source_chunk_id").isNotNull()).select(F.col("source_chunk_id").alias("id"))
    return out.union(back).distinct()


def chunks_for_entity(edges: DataFrame, chunks: DataFrame, entity: str) -> DataFrame:
    """The chunks joined to an entity by an edge of any type; order them by created_at."""
    return chunks.join(chunk_ids_for(edges, entity), "id", "left_semi")
