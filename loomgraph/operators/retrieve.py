"""Retrieval strategies: vector only, contextual, multi-hop, hybrid, document-scoped, entity-centric.

Each is one lazy plan: seeds by vector, joined with edges for each hop and with paths. Results have id, score,
similarity_score, graph_distance and retrieval_method, in the order of the score to nine digits, then of the id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.chunks import hierarchy
from loomgraph.operators.entities import chunk_ids_for
from loomgraph.operators.traverse import adjacency, bfs, neighbours
from loomgraph.operators.vector import ranked, top_k
from loomgraph.runtime import cut
from loomgraph.schema import QueryConfig

COLUMNS = ["id", "score", "similarity_score", "graph_distance", "retrieval_method"]


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS).orderBy(F.round("score", 9).desc(), "id")


def _row(score: Column, similarity: Column, distance: Column, method: str) -> list[Column]:
    return ["id", score.alias("score"), similarity.alias("similarity_score"), distance.cast("int").alias("graph_distance"), F.lit(method).alias("retrieval_method")]


def _seeds(chunks: DataFrame, query: Sequence[float], c: QueryConfig) -> DataFrame:
    """At most top_k rows, so their ranking and broadcast are bounded. They are found once, as plans read them several times."""
    found = ranked(top_k(chunks, query, c.top_k, c.similarity_threshold, c.document_rids)).select("id", "path", "similarity", "rank")
    return chunks.sparkSession.createDataFrame(found.collect(), found.schema)


def _scope(chunks: DataFrame, c: QueryConfig) -> DataFrame:
    return chunks.filter(F.col("document_rid").isin(list(c.document_rids))) if c.strict_scope and c.document_rids else chunks


def _as_vector(seeds: DataFrame) -> DataFrame:
    return seeds.select(*_row(F.col("similarity"), F.col("similarity"), F.lit(0), "vector"))


def vector_only(chunks: DataFrame, query: Sequence[float], c: QueryConfig = QueryConfig()) -> DataFrame:
    return _ordered(_as_vector(_seeds(chunks, query, c)))


def _steps(edges: DataFrame, c: QueryConfig, time: str) -> DataFrame:
    return adjacency(edges, c.edge_types, c.direction, time)


def _context(seeds: DataFrame, chunks: DataFrame, c: QueryConfig) -> DataFrame:
    s = seeds.select("rank", "similarity", "path")
    return hierarchy(F.broadcast(s), chunks, c.include_ancestors, c.include_descendants, c.include_siblings)


def contextual(chunks: DataFrame, edges: DataFrame, query: Sequence[float], c: QueryConfig = QueryConfig(), time: str = "created_at") -> DataFrame:
    """Seeds; their neighbours at similarity times graph weight; their hierarchical context at similarity times
    hierarchy weight. The first seed by rank that reaches a chunk decides, neighbours before hierarchy. Not cut to top_k."""
    seeds, all_ = _seeds(chunks, query, c), _scope(chunks, c)
    start = F.broadcast(seeds.select(F.struct("rank", "similarity").alias("seed"), "id"))
    near = neighbours(start, all_, _steps(edges, c, time)).select(F.col("seed.rank").alias("rank"), F.lit(0).alias("prio"), "id", (F.col("seed.similarity") * c.graph_weight).alias("score"))
    above = _context(seeds, all_, c).select("rank", F.lit(1).alias("prio"), "id", (F.col("similarity") * c.hierarchy_weight).alias("score"))
    first = near.unionByName(above).groupBy("id").agg(F.min(F.struct("rank", "prio", "score")).alias("f"))
    rest = first.join(F.broadcast(seeds.select("id")), "id", "left_anti").withColumn("m", F.when(F.col("f.prio") == 0, F.lit("graph_neighbor")).otherwise("hierarchical"))
    rest = rest.select("id", F.col("f.score").alias("score"), F.lit(0.0).alias("similarity_score"), (1 - F.col("f.prio")).cast("int").alias("graph_distance"), F.col("m").alias("retrieval_method"))
    return _ordered(_as_vector(seeds).unionByName(rest))


def multi_hop(chunks: DataFrame, edges: DataFrame, query: Sequence[float], c: QueryConfig = QueryConfig(), time: str = "created_at") -> DataFrame:
    """Seeds, and what breadth-first search from them finds at distance d, at similarity times graph weight over d + 1;
    the first seed by rank decides, even if a later one is nearer. Not cut to top_k."""
    seeds = _seeds(chunks, query, c)
    start = F.broadcast(seeds.select(F.struct("rank", "similarity").alias("seed"), "id"))
    found = bfs(start, _scope(chunks, c), _steps(edges, c, time), c.max_hops).filter("distance > 0")
    first = found.groupBy("id").agg(F.min(F.struct("seed", "distance")).alias("f"))
    rest = first.join(F.broadcast(seeds.select("id")), "id", "left_anti")
    score = F.col("f.seed.similarity") * c.graph_weight / (F.col("f.distance") + 1)
    return _ordered(_as_vector(seeds).unionByName(rest.select(*_row(score, F.lit(0.0), F.col("f.distance"), "multi_hop"))))


def hybrid_scores(chunks: DataFrame, edges: DataFrame, seeds: DataFrame, c: QueryConfig, time: str = "created_at") -> DataFrame:
    """All candidates of the hybrid strategy for ``seeds`` (id, path, similarity, rank), not cut.

    A seed begins with similarity times vector weight; each chunk that search from a seed finds at distance d > 0 gets
    graph weight over d, and each hierarchical hit the hierarchy weight, self included. What seeds of a smaller rank add
    to a later seed is lost, as that one's entry is written anew. The distance of a chunk is that of its first addition.
    """
    parts = [_context(seeds, chunks, c).select("rank", F.lit(1).alias("kind"), F.lit(0).alias("distance"), "id", F.lit(c.hierarchy_weight).alias("amount"))]
    if c.max_hops > 0:
        start = F.broadcast(seeds.select(F.col("rank").alias("seed"), "id"))
        found = bfs(start, chunks, _steps(edges, c, time), c.max_hops).filter("distance > 0")
        parts.append(found.select(F.col("seed").alias("rank"), F.lit(0).alias("kind"), "distance", "id", F.try_divide(F.lit(c.graph_weight), F.col("distance")).alias("amount")))
    adds = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    own = F.broadcast(seeds.select("id", F.col("rank").alias("r"), F.col("similarity").alias("s")))
    kept = adds.join(own, "id", "left").filter(F.col("r").isNull() | (F.col("rank") >= F.col("r")))
    begun = seeds.select("id", F.col("rank").alias("r"), F.col("similarity").alias("s"), F.lit(-1).alias("rank"), F.lit(0).alias("kind"), F.lit(0).alias("distance"), (F.col("similarity") * c.vector_weight).alias("amount"))
    every = kept.select(begun.columns).unionByName(begun)
    out = every.groupBy("id").agg(F.sum("amount").alias("score"), F.coalesce(F.max("s"), F.lit(0.0)).alias("similarity_score"), F.min(F.struct("rank", "kind", "distance")).alias("f"))
    return out.select("id", "score", "similarity_score", F.col("f.distance").alias("graph_distance"), F.lit("hybrid").alias("retrieval_method"))


def hybrid(chunks: DataFrame, edges: DataFrame, query: Sequence[float], c: QueryConfig = QueryConfig(), time: str = "created_at") -> DataFrame:
    """The top_k candidates by the sum of vector, graph and hierarchy scores."""
    return _ordered(hybrid_scores(_scope(chunks, c), edges, _seeds(chunks, query, c), c, time)).limit(c.top_k)


def document_scoped(chunks: DataFrame, edges: DataFrame, query: Sequence[float], rids: Sequence[str], c: QueryConfig = QueryConfig(), time: str = "created_at") -> DataFrame:
    """Hybrid with seeds from the documents ``rids``; what seeds lead to may lie elsewhere unless ``strict_scope``."""
    if not rids:
        raise ValueError("at least one document is needed")
    return hybrid(chunks, edges, query, replace(c, document_rids=tuple(rids)), time)


def entity_centric(chunks: DataFrame, edges: DataFrame, entity: str, c: QueryConfig = QueryConfig(), time: str = "created_at", order: Column | None = None) -> DataFrame:
    """Chunks joined to an entity at 1, and what search from them finds at distance d at graph weight over d.

    The first chunk, by ``order`` (time of creation, then id), that finds another decides. Cut to top_k if it is
    positive.
    """
    ids = chunk_ids_for(edges, entity)
    direct = cut(chunks.join(ids, "id", "left_semi").select("id", F.struct(F.col("created_at") if order is None else order, F.col("id")).alias("o")))
    out = direct.select(*_row(F.lit(1.0), F.lit(0.0), F.lit(0), "entity_centric"))
    if c.max_hops > 0:
        found = bfs(direct.select(F.col("o").alias("seed"), "id"), chunks, _steps(edges, c, time), c.max_hops).filter("distance > 0")
        first = found.groupBy("id").agg(F.min(F.struct("seed", "distance")).alias("f")).join(direct.select("id"), "id", "left_anti")
        out = out.unionByName(first.select(*_row(F.try_divide(F.lit(c.graph_weight), F.col("f.distance")), F.lit(0.0), F.col("f.distance"), "entity_fanout")))
    out = _ordered(out)
    return out.limit(c.top_k) if c.top_k > 0 else out


def retrieve(strategy: str, chunks: DataFrame, edges: DataFrame, query: Sequence[float], c: QueryConfig = QueryConfig(), time: str = "created_at") -> DataFrame:
    """One of ``vector``, ``contextual``, ``multi_hop``, ``hybrid`` by name."""
    if strategy == "vector":
        return vector_only(chunks, query, c)
    known = {"contextual": contextual, "multi_hop": multi_hop, "hybrid": hybrid}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}")
    return known[strategy](chunks, edges, query, c, time)
