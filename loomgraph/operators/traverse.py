"""Traversal of the chunk graph, for many start chunks in one plan."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut


def adjacency(edges: DataFrame, edge_types: Sequence[str] = (), direction: str = "out", time: str = "created_at") -> DataFrame:
    """(src, dst, k): steps between chunks. ``out`` follows edges forward, ``both`` bidirectional ones backward as well.

    ``k`` sorts steps as edges are ordered: by weight (missing first, largest next), time, id.
    """
    if direction not in ("out", "both"):
        raise ValueError("direction is 'out' or 'both'")
    e = edges.filter(F.col("source_chunk_id").isNotNull() & F.col("target_chunk_id").isNotNull())
    if edge_types:
        e = e.filter(F.col("edge_type").isin(list(edge_types)))
    k = F.struct(F.col("weight").isNotNull().alias("w"), (-F.col("weight")).alias("v"), F.col(time).isNull().alias("t"), F.col(time).alias("u"), F.col("id").alias("id")).alias("k")
    out = e.select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst"), k)
    if direction == "both":
        out = out.unionAll(e.filter("bidirectional").select(F.col("target_chunk_id").alias("src"), F.col("source_chunk_id").alias("dst"), k))
    return out


def bfs(seeds: DataFrame, chunks: DataFrame, steps: DataFrame, max_hops: int) -> DataFrame:
    """(seed, id, distance, path, ord): chunks within ``max_hops`` steps of each seed, by first discovery.

    ``seeds`` has seed and id (the start chunk, which must be in ``chunks``). All seeds advance together, a join for
    each hop. ``ord`` is an array whose order is the order of discovery among chunks of one seed and distance: it holds
    the sort key of each step on the path, so no numbering of a whole level is needed. Steps to missing chunks are
    skipped. Each hop but the last is written to the checkpoint folder, as the next one reads it twice.
    """
    there = chunks.select(F.col("id").alias("dst"))
    steps = steps.join(there, "dst", "left_semi")
    empty = F.array().cast("array<struct<w:boolean,v:double,t:boolean,u:%s,id:string>>" % steps.schema["k"].dataType["u"].dataType.simpleString())
    front = seeds.join(chunks.select("id"), "id", "left_semi").select("seed", "id", F.lit(0).alias("distance"), F.array("id").alias("path"), empty.alias("ord"))
    seen = front
    for hop in range(1, max_hops + 1):
        reach = front.join(steps, front["id"] == steps["src"]).select("seed", "dst", F.concat("path", F.array("dst")).alias("path"), F.concat("ord", F.array("k")).alias("ord"))
        new = reach.join(seen.select("seed", F.col("id").alias("dst")), ["seed", "dst"], "left_anti")
        front = new.groupBy("seed", "dst").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord")).select("seed", F.col("dst").alias("id"), F.lit(hop).alias("distance"), "path", "ord")
        if hop < max_hops:
            front = cut(front)
        seen = seen.unionAll(front)
    return seen


def dfs(seeds: DataFrame, chunks: DataFrame, steps: DataFrame, max_hops: int) -> DataFrame:
    """(seed, id, distance, path, ord): depth-first order from each seed, distances along its paths, ``ord`` from 0.

    Depth-first order depends on all steps before it, so each seed's neighbourhood, found by ``bfs``, is walked by one
    task; its size is bounded by ``max_hops``.
    """
    area = bfs(seeds, chunks, steps, max_hops).select("seed", "id", "distance")
    here = area.join(steps, area["id"] == steps["src"]).select("seed", "src", "dst", F.col("k.w").alias("w"), F.col("k.v").alias("v"), F.col("k.t").alias("t"), F.col("k.u").cast("string").alias("u"), F.col("k.id").alias("eid"))
    inside = here.join(area.select("seed", F.col("id").alias("dst")), ["seed", "dst"], "left_semi")
    starts = area.filter("distance = 0").select("seed", F.lit(None).cast("string").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("boolean").alias("w"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("boolean").alias("t"), F.lit(None).cast("string").alias("u"), F.lit("").alias("eid"))
    seed_type = seeds.schema["seed"].dataType.simpleString()
    number = steps.schema["k"].dataType["u"].dataType.simpleString() in ("bigint", "int")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf[pdf["src"].isna()]["dst"].iloc[0]
        todo = pdf[pdf["src"].notna()].copy()
        todo["u"] = pd.to_numeric(todo["u"]) if number else todo["u"]
        todo = todo.sort_values(["w", "v", "t", "u", "eid"])
        to: dict[str, list[str]] = {}
        for a, b in zip(todo["src"], todo["dst"]):
            to.setdefault(a, []).append(b)
        seen, out, stack = {start}, [(start, 0, [start])], [(iter(to.get(start, ())), [start])]
        while stack:
            it, path = stack[-1]
            nxt = next((x for x in it if x not in seen), None) if len(path) <= max_hops else None
            if nxt is None:
                stack.pop()
                continue
            seen.add(nxt)
            out.append((nxt, len(path), [*path, nxt]))
            stack.append((iter(to.get(nxt, ())), [*path, nxt]))
        return pd.DataFrame([(pdf["seed"].iloc[0], i, d, p, k) for k, (i, d, p) in enumerate(out)], columns=["seed", "id", "distance", "path", "ord"])

    return inside.select("seed", "src", "dst", "w", "v", "t", "u", "eid").unionAll(starts).groupBy("seed").applyInPandas(walk, f"seed {seed_type}, id string, distance int, path array<string>, ord int")


def neighbours(seeds: DataFrame, chunks: DataFrame, steps: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(seed, id): distinct chunks one step from each seed. A loop gives the seed itself, unless ``exclude_self``."""
    s = seeds.select("seed", F.col("id").alias("src"))
    near = s.join(steps.select("src", "dst"), "src").join(chunks.select(F.col("id").alias("dst")), "dst", "left_semi")
    if exclude_self:
        near = near.filter("src <> dst")
    return near.select("seed", F.col("dst").alias("id")).distinct()


def walks(start: str, steps: DataFrame, max_depth: int) -> DataFrame:
    """(chunk_id, depth, path): every simple path of at most ``max_depth`` steps from ``start``, itself included.

    A chunk comes once for each depth and path; chunks needn't exist.
    """
    spark = steps.sparkSession
    level = spark.range(1).select(F.lit(start).alias("chunk_id"), F.lit(0).alias("depth"), F.array(F.lit(start)).alias("path"))
    out = level
    pairs = steps.select("src", "dst").distinct()
    for d in range(1, max_depth + 1):
        level = level.join(pairs, F.col("chunk_id") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("chunk_id"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        if d > 3:
            level = cut(level)
        out = out.unionAll(level)
    return out.distinct()
