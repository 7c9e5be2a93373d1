"""Ingestion: documents to documents, chunks, entities and edges in one set of plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import chunkers, relations
from loomgraph.runtime import cut


@dataclass
class Pipeline:
    """How texts are chunked, embedded, and read for entities and relations. Each part is a function and may be replaced.

    ``chunk`` takes a table of document_id, base_path and text and gives document_id and the columns of a chunk.
    ``embed`` and ``extract`` take texts. ``relate`` takes chunks and mentions (as of ``relations.extract_entities``, with
    entity_id) and gives the columns ``relations.EDGE`` of edges; ``relations.per_chunk`` makes one of a function of a text.
    """

    chunk: Callable[[DataFrame], DataFrame]
    embed: Callable | None = None
    extract: relations.Extractor | None = None
    relate: relations.Relator | None = None

    @staticmethod
    def default(most: int = 500, threshold: float = 0.7, dim: int = 384) -> Pipeline:
        e = chunkers.hashing_embedder(dim)
        return Pipeline(lambda df: chunkers.semantic_chunks(df, "document_id", "text", most, threshold, e), e, relations.capitalised_extractor, relations.default_relations)


def stable_id(*parts: Column | str) -> Column:
    """A UUID made of a hash of its parts, the same in every run."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def process(documents: DataFrame, pipeline: Pipeline, now: Column | None = None, link_mentions: bool = False) -> dict[str, DataFrame]:
    """Tables ``documents``, ``chunks``, ``entities`` and ``edges`` for documents (id, rid, title, source, metadata, content).

    Texts aren't stored with documents. Entities are one per name and type. An edge without a source takes the chunk
    whose path is its metadata's ``extracted_from``. Edges that still lack a source or a target (citations of works that
    aren't here) are dropped; ``link_mentions`` adds an edge from each chunk to the entities in it. A blank content has
    no chunks. Chunks and mentions are written to the checkpoint folder, so that each text is cut, embedded and read once.
    """
    now = F.current_timestamp() if now is None else now
    base = documents.select(F.col("id").alias("document_id"), F.concat(F.lit("doc_"), F.col("rid")).alias("base_path"), F.col("content").alias("text"))
    c = pipeline.chunk(base)
    c = c.withColumn("id", stable_id(F.lit("chunk"), F.col("document_id").cast("string"), "path"))
    c = chunkers.embed(c, "content", pipeline.embed) if pipeline.embed else c.withColumn("embedding", F.lit(None).cast("array<float>"))
    if "metadata" not in c.columns:
        c = c.withColumn("metadata", F.lit("{}"))
    c = cut(c.select("id", "document_id", "content", "path", "embedding", "start_pos", "end_pos", "chunk_index", "metadata", now.alias("created_at")))
    out = {"documents": documents.drop("content").withColumn("created_at", now).withColumn("updated_at", now), "chunks": c}
    if pipeline.extract is not None:
        found = relations.extract_entities(c, pipeline.extract).withColumn("entity_id", stable_id(F.lit("entity"), "name", "entity_type"))
    elif pipeline.relate is not None:
        found = c.sparkSession.createDataFrame([], relations.MENTION)
    else:
        return out
    found = cut(found)
    meta = F.to_json(F.struct("confidence", "start", "end"))
    last = F.struct("chunk_id", "pos")
    out["entities"] = found.groupBy("name", "entity_type").agg(F.first("entity_id").alias("id"), F.max_by(meta, last).alias("metadata")).select("id", "name", "entity_type", "metadata", now.alias("created_at"))
    edges = None
    if pipeline.relate is not None:
        edges = stored_edges(pipeline.relate(c, found), c, now)
    if link_mentions:
        none = F.lit(None).cast("string")
        links = found.select(
            stable_id(F.lit("mention"), "chunk_id", F.col("pos").cast("string")).alias("id"), F.col("chunk_id").alias("source_chunk_id"), none.alias("target_chunk_id"), none.alias("source_entity_id"), F.col("entity_id").alias("target_entity_id"),
            F.lit("entity_mention").alias("edge_type"), F.col("confidence").alias("weight"), F.lit(False).alias("bidirectional"), F.lit("{}").alias("metadata"), now.alias("created_at"),
        )
        edges = links if edges is None else edges.unionByName(links)
    if edges is not None:
        out["edges"] = edges
    return out


def stored_edges(edges: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """The edges (columns ``relations.EDGE``) that can be stored: linked by ``extracted_from``, with a source and a target, and ids."""
    linked = relations.link_extracted(edges, chunks)
    whole = linked.filter(F.coalesce("source_chunk_id", "source_entity_id").isNotNull() & F.coalesce("target_chunk_id", "target_entity_id").isNotNull())
    key = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("source_chunk_id", "target_chunk_id", "source_entity_id", "target_entity_id", "edge_type", "metadata")]
    return whole.select(stable_id(F.lit("edge"), *key).alias("id"), *relations.EDGE, now.alias("created_at"))
