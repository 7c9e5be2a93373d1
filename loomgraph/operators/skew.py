"""Work on keys of which a few hold most rows: fragment-replicate by estimated load.

The load of every key is counted with map-side combining. A key with more rows than a task should take is
split into shards in proportion to its rows; all other keys are hashed into virtual buckets. Shards and buckets
are then bin-packed to tasks, the largest first to the least loaded task, and each row is sent to the task of its
shard or bucket. A matching side is replicated only to the shards of the keys that were split.

Bounds: a split key has more than ``rows / (tasks * SHARES)`` rows, so there are fewer than ``tasks * SHARES``
such keys and fewer than twice as many shards, besides ``tasks * BUCKETS`` buckets. The plan grows with the number
of tasks, not with the data; that is all that the driver holds and that is broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import parallelism

#: A key is split if it has more rows than one such share of a task.
SHARES = 4
#: Virtual buckets of unsplit keys for each task.
BUCKETS = 8
#: Rows planned for a task at most: with more, there are more tasks, up to one for each bucket.
MOST_ROWS = 5_000_000


@dataclass(frozen=True)
class LoadPlan:
    """Where rows go: ``split`` has first unit and number of shards by hash of a split key, ``task_of`` the task of each unit.

    Units are numbered buckets first, then the shards of the split keys.
    """

    tasks: int
    buckets: int
    split: dict[int, tuple[int, int]]
    task_of: list[int]


def pack(loads: list[int], tasks: int) -> list[int]:
    """A task for each load: the largest first, each to the task with the least so far."""
    heap = [(0, t) for t in range(tasks)]
    to = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        have, t = heapq.heappop(heap)
        to[i] = t
        heapq.heappush(heap, (have + loads[i], t))
    return to


def key_hash(keys: list[str]) -> Column:
    """A hash of the key columns that tells null from all values. Keys that share one are merely placed together."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Count the rows of every key of ``df`` and assign keys and shards to tasks. An empty ``df`` gives a plan without splits.

    Without ``tasks`` there are as many as the session's shuffle partitions, or more for very many rows.
    """
    least = tasks or parallelism(df.sparkSession)
    buckets = least * BUCKETS
    # counted once; the counts are kept while they are read twice
    by_key = df.select(key_hash(keys).alias("h")).groupBy("h").agg(F.count("*").alias("n")).persist()
    try:
        rows = by_key.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.sum("n").alias("n"), F.max("n").alias("top")).collect()
        total = sum(r["n"] for r in rows)
        tasks = tasks or min(buckets, max(least, ceil(total / MOST_ROWS)))
        share = max(1, ceil(total / (tasks * SHARES)))
        loads = [0] * buckets
        for r in rows:
            loads[r["b"]] = r["n"]
        split: dict[int, tuple[int, int]] = {}
        if any(r["top"] > share for r in rows):
            for r in by_key.filter(F.col("n") > share).collect():
                shards = ceil(r["n"] / share)
                split[r["h"]] = (len(loads), shards)
                loads[r["h"] % buckets] -= r["n"]
                loads += [ceil(r["n"] / shards)] * shards
    finally:
        by_key.unpersist()
    return LoadPlan(tasks, buckets, split, pack(loads, tasks))


def _split_table(df: DataFrame, plan: LoadPlan) -> DataFrame:
    rows = [(h, first, shards) for h, (first, shards) in plan.split.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "_h long, _first long, _shards long"))


def _with_task(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df``, with its columns ``_h``, ``_first`` and ``_shard``, and the task of its unit; ``_first`` is dropped."""
    tasks = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(plan.task_of)), "_unit long, _task int"))
    unit = F.coalesce(F.col("_first") + F.col("_shard"), F.pmod("_h", F.lit(plan.buckets)))
    return df.withColumn("_unit", unit).join(tasks, "_unit").drop("_unit", "_first")


def dealt(df: DataFrame, keys: list[str], by: list[str], plan: LoadPlan) -> DataFrame:
    """``df`` with ``_h``, ``_shard``, ``_task`` and ``_split``: rows of a split key are dealt over its shards by a hash of ``by``."""
    at = df.withColumn("_h", key_hash(keys)).join(_split_table(df, plan), "_h", "left")
    shard = F.coalesce(F.pmod(F.xxhash64(*by, F.lit(7)), "_shards"), F.lit(0))
    return _with_task(at.withColumn("_shard", shard).withColumn("_split", F.col("_shards").isNotNull()).drop("_shards"), plan)


def replicated(df: DataFrame, keys: list[str], plan: LoadPlan) -> DataFrame:
    """``df`` with ``_h``, ``_shard``, ``_task`` and ``_split``: rows of a split key once for each of its shards."""
    at = df.withColumn("_h", key_hash(keys)).join(_split_table(df, plan), "_h", "left")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_shards"), F.lit(1)) - 1))
    return _with_task(at.withColumn("_shard", copies).withColumn("_split", F.col("_shards").isNotNull()).drop("_shards"), plan)


def spread(df: DataFrame, keys: list[str], by: list[str], plan: LoadPlan) -> DataFrame:
    """``dealt``, each row in the partition of its task.

    Rows equal in ``keys`` and ``by`` come into the same shard, so counts of distinct ``by`` add up over shards.
    """
    return dealt(df, keys, by, plan).drop("_split").repartitionById(plan.tasks, "_task")


def self_join_shards(df: DataFrame, keys: list[str], by: list[str], tasks: int | None = None) -> DataFrame:
    """``df`` arranged for joining rows of equal ``keys`` with each other inside partitions, whatever the skew.

    Adds ``_h`` (a hash of the keys), ``_shard``, ``asks`` and ``answers``: a pair of rows is found where one asks and
    the other answers in the same (``_h``, ``_shard``). Rows of unsplit keys do both, once; of a split key, rows ask
    in one shard and answer in all. Partitions are sorted by ``_h`` and ``_shard``. Null keys are left out.
    """
    some = df.dropna(subset=keys)
    plan = plan_load(some, keys, tasks)
    asking = dealt(some, keys, by, plan).withColumn("asks", F.lit(True)).withColumn("answers", ~F.col("_split"))
    if plan.split:
        heavy = replicated(some, keys, plan).filter("_split").withColumn("asks", F.lit(False)).withColumn("answers", F.lit(True))
        asking = asking.unionByName(heavy)
    return asking.drop("_split").repartitionById(plan.tasks, "_task").drop("_task").sortWithinPartitions("_h", "_shard")


def join_shards(asking: DataFrame, answering: DataFrame, keys: list[str], by: list[str], tasks: int | None = None) -> DataFrame:
    """Two tables of the same columns arranged as by ``self_join_shards``: rows of one ask, rows of the other answer."""
    a, b = asking.dropna(subset=keys), answering.dropna(subset=keys)
    plan = plan_load(a, keys, tasks)
    both = dealt(a, keys, by, plan).withColumn("asks", F.lit(True)).unionByName(replicated(b, keys, plan).withColumn("asks", F.lit(False)))
    return both.drop("_split").repartitionById(plan.tasks, "_task").drop("_task").sortWithinPartitions("_h", "_shard", "asks")


def pair_counts(df: DataFrame, keys: list[str], id_col: str, targets: list[str], weight: str, tasks: int | None = None) -> DataFrame:
    """Per key: ``n_rows``, ``n_ids``, ``n_targets`` (exact distinct numbers) and ``mean_weight``, whatever the skew.

    Null is a key like any other value, and values are compared as they are written. Null ids and targets aren't
    counted as distinct, null weights not averaged; a key without weights has a null mean. A row with two targets
    counts for both, and equal values in different target columns are different targets. Repeated rows count in
    ``n_rows`` and in the mean as often as they come. An empty ``df`` gives no rows; other columns are ignored.

    Ids and targets go through one pass: a row becomes one value for its id, which carries the weight, and one for
    each target. Equal values of a key come into the same shard, so that their distinct numbers add up over shards.
    """
    plan = plan_load(df, keys, tasks)
    value = lambda tag, v, n, w: F.struct(F.lit(tag).alias("_tag"), v.cast("string").alias("_value"), n.cast("long").alias("_n"), w.cast("double").alias("_w"))
    none = F.lit(None)
    each = [value(0, F.col(id_col), F.lit(1), F.col(weight))]
    each += [F.when(F.col(t).isNotNull(), value(i, F.col(t), none, none)) for i, t in enumerate(targets, 1)]
    values = df.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("_v")).select(*keys, "_v.*")
    once = spread(values, keys, ["_tag", "_value"], plan).groupBy("_task", "_shard", *keys, "_tag", "_value")
    once = once.agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_s"), F.count("_w").alias("_c"))
    sums = {"n_rows": F.sum("_n"), "n_ids": F.count_if((F.col("_tag") == 0) & F.col("_value").isNotNull()), "n_targets": F.count_if(F.col("_tag") > 0), "_s": F.sum("_s"), "_c": F.sum("_c")}
    parts = once.groupBy("_task", "_shard", *keys).agg(*[a.alias(c) for c, a in sums.items()])
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return total.select(*keys, "n_rows", "n_ids", "n_targets", F.try_divide("_s", "_c").alias("mean_weight"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], tasks: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Inner equi-join of a skewed ``left`` with ``right`` on ``keys``; null keys match nothing, as in SQL.

    Rows of a split key of ``left`` are dealt over its shards one by one, by their number in their partition, so that
    shards are even whatever the other columns hold; rows of ``right`` go to their key's task, and to every shard of a
    split key. A row's number is the same whenever a partition is computed again, if the rows of ``left`` come in a
    fixed order, as from files or a checkpoint; otherwise name columns ``by`` whose hash deals them. Repeated rows
    multiply as in any join. Columns of ``right`` that ``left`` has too must be renamed before; columns ``_h``,
    ``_shard``, ``_task`` and ``_deal`` are used and dropped.
    """
    l, r = left.dropna(subset=keys), right.dropna(subset=keys)
    plan = plan_load(l, keys, tasks)
    ours = spread(l.withColumn("_deal", F.xxhash64(*by) if by else F.monotonically_increasing_id()), keys, ["_deal"], plan).drop("_h", "_deal")
    theirs = replicated(r, keys, plan).drop("_h", "_split").repartitionById(plan.tasks, "_task")
    return ours.join(theirs, ["_task", "_shard", *keys]).drop("_task", "_shard")
