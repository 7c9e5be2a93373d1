"""Schemas of the four tables, legal edge types, and the query configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_s, _l, _i, _ts = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()

DOCUMENTS = T.StructType([T.StructField("id", _l, False), T.StructField("rid", _s), T.StructField("title", _s, False), T.StructField("source", _s), T.StructField("metadata", _s), T.StructField("created_at", _ts), T.StructField("updated_at", _ts)])
CHUNKS = T.StructType(
    [T.StructField("id", _s, False), T.StructField("document_id", _l, False), T.StructField("content", _s, False), T.StructField("path", _s, False), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(c, _i) for c in ("start_pos", "end_pos", "chunk_index")]
    + [T.StructField("metadata", _s), T.StructField("created_at", _ts)]
)
EDGES = T.StructType(
    [T.StructField("id", _s, False)]
    + [T.StructField(c, _s) for c in ("source_chunk_id", "target_chunk_id", "source_entity_id", "target_entity_id")]
    + [T.StructField("edge_type", _s, False), T.StructField("weight", T.DoubleType()), T.StructField("bidirectional", T.BooleanType()), T.StructField("metadata", _s), T.StructField("created_at", _ts)]
)
ENTITIES = T.StructType([T.StructField("id", _s, False), T.StructField("name", _s, False), T.StructField("entity_type", _s, False), T.StructField("metadata", _s), T.StructField("created_at", _ts)])
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "edges": EDGES, "entities": ENTITIES}

EDGE_TYPES = ("semantic", "hierarchical", "reference", "entity_mention", "temporal", "causal", "custom")


@dataclass(frozen=True)
class QueryConfig:
    """Parameters of retrieval. ``follow_bidirectional`` is accepted and has no effect; use ``direction``."""

    top_k: int = 5
    similarity_threshold: float = 0.7
    document_rids: tuple[str, ...] = ()
    max_hops: int = 2
    edge_types: tuple[str, ...] = field(default=())
    follow_bidirectional: bool = True
    include_ancestors: bool = False
    include_descendants: bool = False
    include_siblings: bool = True
    vector_weight: float = 0.6
    graph_weight: float = 0.3
    hierarchy_weight: float = 0.1
    direction: str = "out"
    strict_scope: bool = False
