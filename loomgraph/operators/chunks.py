"""Chunks: insert, look up, the hierarchy of paths, delete, new embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths


def insert_chunks(chunks: DataFrame, new: DataFrame, documents: DataFrame, dim: int = 384) -> DataFrame:
    """Chunks with ``new`` appended. An empty embedding becomes null; another length, an unknown document, or a missing
    content or path is an error."""
    rows = new.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding"))).select(chunks.columns)
    if rows.filter("content IS NULL OR path IS NULL OR document_id IS NULL").limit(1).count():
        raise ValueError("content, path and document_id must not be null")
    if rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).limit(1).count():
        raise ValueError(f"an embedding doesn't have {dim} values")
    if rows.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").limit(1).count():
        raise ValueError("a chunk belongs to no document")
    return chunks.unionByName(rows)


def with_rid(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's rid; null where there is no such document."""
    d = documents.select(F.col("id").alias("document_id"), F.col("rid").alias("document_rid"))
    return chunks.join(d, "document_id", "left")


def select_chunk(chunks: DataFrame, documents: DataFrame, id_: str) -> DataFrame:
    return with_rid(chunks.filter(F.col("id") == id_), documents)


def chunks_by_document(chunks: DataFrame, documents: DataFrame, rid: str) -> DataFrame:
    d = documents.filter(F.col("rid") == rid).select(F.col("id").alias("document_id"), F.col("rid").alias("document_rid"))
    return chunks.join(d, "document_id").orderBy(F.asc_nulls_last("chunk_index"), "created_at", "id")


def descendants(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks at ``path`` and below; both conditions reach the Parquet scan."""
    return chunks.filter((F.col("path") == path) | F.col("path").startswith(path + ".")).orderBy(paths.labels(F.col("path")), "id")


def ancestors(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks at ``path`` and above."""
    return chunks.filter(F.col("path").isin(paths.literal_prefixes(path))).orderBy(paths.labels(F.col("path")), "id")


def siblings(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks of other paths under the same parent; roots are siblings of each other."""
    up = ".".join(path.split(".")[:-1])
    p = F.col("path")
    near = p.startswith(up + ".") if up else F.lit(True)
    return chunks.filter(near & (paths.nlevel(p) == len(path.split("."))) & (p != path)).orderBy(paths.labels(p), "id")


def hierarchy(seeds: DataFrame, chunks: DataFrame, ancestors: bool, descendants: bool, siblings: bool) -> DataFrame:
    """(seed columns, id, src): for every row of ``seeds`` (with a column path) its hierarchical context.

    Equi-joins on prefixes or parents, whatever the number of seeds. Self is in the ancestors and in the descendants,
    and a chunk comes once for each relation that it has to the seed.
    """
    c = chunks.select("id", F.col("path").alias("_path"))
    parts = []
    if ancestors:
        parts.append(seeds.withColumn("_path", F.explode(paths.prefixes(F.col("path")))).join(c, "_path").withColumn("src", F.lit("ancestor")))
    if descendants:
        below = c.withColumn("path", F.explode(paths.prefixes(F.col("_path"))))
        parts.append(seeds.join(below, "path").withColumn("src", F.lit("descendant")))
    if siblings:
        s = seeds.withColumn("_up", paths.parent(F.col("path"))).withColumn("_n", paths.nlevel(F.col("path")))
        o = c.withColumn("_up", paths.parent(F.col("_path"))).withColumn("_n", paths.nlevel(F.col("_path")))
        parts.append(s.join(o, ["_up", "_n"]).filter(F.col("path") != F.col("_path")).drop("_up", "_n").withColumn("src", F.lit("sibling")))
    out = None
    for p in parts:
        p = p.select(*seeds.columns, "id", "src")
        out = p if out is None else out.unionAll(p)
    if out is None:
        return seeds.select("*", F.lit(None).cast("string").alias("id"), F.lit("").alias("src")).limit(0)
    return out


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id"), "id", "left_anti").select(chunks.columns)


def update_chunk_embeddings(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Embeddings of the ids in ``changes`` (id, embedding) replaced."""
    c = changes.select("id", F.col("embedding").alias("_e"), F.lit(1).alias("_hit"))
    new = F.when(F.col("_hit").isNotNull(), F.col("_e")).otherwise(F.col("embedding")).alias("embedding")
    return chunks.join(c, "id", "left").select(*[new if x == "embedding" else x for x in chunks.columns])
