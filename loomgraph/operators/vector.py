"""Vector search: exact top k, with context, for many queries at once; an index over clusters as an option."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import vectors
from loomgraph.operators.chunks import hierarchy
from loomgraph.runtime import cut


def _scored(chunks: DataFrame, query: Sequence[float], threshold: float, rids: Sequence[str]) -> DataFrame:
    some = chunks.filter(F.col("document_rid").isin(list(rids))) if rids else chunks
    sim = vectors.cosine(F.col("embedding"), vectors.literal_vector(query))
    return some.filter(F.col("embedding").isNotNull()).withColumn("similarity", sim).filter(F.col("similarity") >= threshold)


def top_k(chunks: DataFrame, query: Sequence[float], k: int | None = 5, threshold: float = 0.0, rids: Sequence[str] = ()) -> DataFrame:
    """The k chunks (None: all) most similar to ``query`` with a similarity of at least ``threshold``, of documents ``rids`` if given.

    Similarity is cosine in double precision. A chunk whose cosine isn't defined isn't found. Ties (to nine digits) by id.
    """
    hit = _scored(chunks, query, threshold, rids).orderBy(F.round("similarity", 9).desc(), "id")
    return hit if k is None else hit.limit(k)


def ranked(seeds: DataFrame) -> DataFrame:
    """The result of ``top_k`` (at most k rows) with rank 0, 1, …"""
    order = W.orderBy(F.round("similarity", 9).desc(), "id")
    return seeds.withColumn("rank", F.row_number().over(order) - 1)


def top_k_with_context(chunks: DataFrame, query: Sequence[float], k: int = 5, ancestors: bool = True, descendants: bool = True, threshold: float = 0.0, rids: Sequence[str] = ()) -> DataFrame:
    """(id, path, similarity, is_match): the k best and the chunks above or below them, each once.

    A chunk that belongs to several seeds is taken as a match first, then with the highest similarity, then for the
    smaller seed id. Context isn't restricted to ``rids``.
    """
    found = top_k(chunks, query, k, threshold, rids).select(F.col("id").alias("seed"), "similarity", "path")
    seeds = chunks.sparkSession.createDataFrame(found.collect(), found.schema)  # k rows at most, read several times
    own = seeds.select("seed", "similarity", F.col("seed").alias("id"))
    near = hierarchy(F.broadcast(seeds), chunks, ancestors, descendants, False).select("seed", "similarity", "id").unionByName(own)
    best = near.groupBy("id").agg(F.min_by(F.struct("similarity", "seed"), F.struct(F.col("id") != F.col("seed"), -F.col("similarity"), "seed")).alias("s"), F.max(F.col("id") == F.col("seed")).alias("is_match"))
    return chunks.select("id", "path").join(best, "id").select("id", "path", F.col("s.similarity").alias("similarity"), "is_match")


def batch_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0, block: int = 512) -> DataFrame:
    """(query_id, id, similarity): the k best chunks for each row (query_id, embedding) of ``queries``.

    The queries are a stated set, held by the driver and sent to the tasks in blocks of ``block``; each task keeps the k
    best of its chunks for each query, so that only those are shuffled. Undefined cosines aren't found.
    """
    out = None
    rows = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding").toLocalIterator()
    part: list = []

    def flush(out):
        ids = [r["query_id"] for r in part]
        found = chunks.select("id", "embedding").filter(F.col("embedding").isNotNull()).mapInPandas(_block_scorer(ids, [list(r["embedding"]) for r in part], k, threshold), f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, similarity double")
        return found if out is None else out.unionByName(found)

    for r in rows:
        part.append(r)
        if len(part) == block:
            out, part = flush(out), []
    if part or out is None:
        out = flush(out)
    w = W.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _block_scorer(ids: list, embeddings: list[list[float]], k: int, threshold: float):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[int, tuple[list, np.ndarray]] = {}
        for dim in {len(e) for e in embeddings}:
            at = [i for i, e in enumerate(embeddings) if len(e) == dim and np.isfinite(e).all() and np.any(e)]
            if at:
                q = np.array([embeddings[i] for i in at], np.float64)
                groups[dim] = ([ids[i] for i in at], q / np.linalg.norm(q, axis=1, keepdims=True))
        best = {n: (np.empty(0), np.empty(0, object)) for names, _ in groups.values() for n in names}
        for pdf in batches:
            for dim, (names, q) in groups.items():
                mine = pdf[[len(e) == dim for e in pdf["embedding"]]]
                if not len(mine):
                    continue
                x = np.stack(mine["embedding"].to_numpy()).astype(np.float64)
                with np.errstate(all="ignore"):
                    s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                s = np.where(np.isfinite(s), s, -2)
                chunk = mine["id"].to_numpy()
                m = min(k, s.shape[1])
                # the m-th best of each query here; what ties with it to nine digits is kept until ids decide
                floor = np.maximum(-np.partition(-s, m - 1, axis=1)[:, m - 1] - 1e-9, threshold) if m else np.full(len(names), np.inf)
                for name, row, least in zip(names, s, floor):
                    j = np.flatnonzero(row >= least)
                    if len(j):
                        have, ids_ = best[name]
                        sims, at = np.concatenate([have, row[j]]), np.concatenate([ids_, chunk[j]])
                        order = np.lexsort((at.astype(str), -np.round(sims, 9)))[:k]
                        best[name] = sims[order], at[order]
        rows = [(n, c, float(v)) for n, (sims, at) in best.items() for v, c in zip(sims, at)]
        yield pd.DataFrame(rows, columns=["query_id", "id", "similarity"])

    return score


@dataclass(frozen=True)
class IndexChoice:
    """How vectors are searched: ``exact``, ``ivfflat`` (clusters, of which the nearest ``probes`` are searched), or
    ``hnsw``, whose parameters are kept but which is served by the exact search, as Spark has no counterpart."""

    kind: str = "exact"
    params: dict = field(default_factory=dict)

    @staticmethod
    def of(kind: str, params: dict | None = None) -> IndexChoice:
        """A checked choice; parameters of a wrong type fall back to their defaults."""
        defaults = {"exact": {}, "hnsw": {"m": 16, "ef_construction": 64}, "ivfflat": {"lists": 100, "probes": 10}}
        if kind not in defaults:
            raise ValueError(f"unknown index type {kind!r}")
        given = params or {}
        return IndexChoice(kind, {k: given[k] if isinstance(given.get(k), int) and not isinstance(given.get(k), bool) else v for k, v in defaults[kind].items()})


class ClusterIndex:
    """Vectors by the nearest of a number of centres; a search reads the clusters of the nearest centres only.

    The centres are fitted on at most ``sample`` vectors; every vector is indexed. The index is written once, into
    ``folder`` partitioned by cluster, so that other clusters aren't read; without a folder it is kept in the
    checkpoint folder, and other clusters are read but not compared.
    """

    def __init__(self, chunks: DataFrame, lists: int = 100, seed: int = 1, sample: int = 100_000, folder: str | None = None):
        v = chunks.filter(vectors.cosine(F.col("embedding"), F.col("embedding")).isNotNull())
        n = v.count()
        some = v.select(array_to_vector("embedding").alias("features"))
        if n > sample:
            some = some.sample(fraction=sample / n, seed=seed)
        self.model = KMeans(k=max(2, min(lists, n // 2)), distanceMeasure="cosine", seed=seed, maxIter=10).fit(some)
        indexed = self.model.transform(v.withColumn("features", array_to_vector("embedding"))).withColumnRenamed("prediction", "cluster").drop("features")
        if folder:
            # rows of a cluster are gathered in as many files as tasks hold, not in one task
            indexed.write.partitionBy("cluster").parquet(folder)
            self.chunks = chunks.sparkSession.read.schema(indexed.schema).parquet(folder)
        else:
            self.chunks = cut(indexed)

    def top_k(self, query: Sequence[float], k: int = 5, threshold: float = 0.0, probes: int = 10, rids: Sequence[str] = ()) -> DataFrame:
        q = np.array(query, np.float64)
        centres = np.array(self.model.clusterCenters())
        sims = centres @ q / (np.linalg.norm(centres, axis=1) * np.linalg.norm(q) + 1e-300)
        near = [int(i) for i in np.argsort(-sims)[:probes]]
        return top_k(self.chunks.filter(F.col("cluster").isin(near)), query, k, threshold, rids)
