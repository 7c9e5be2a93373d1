"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import fragment_replicate_join
from loomgraph.runtime import cut

#: A vertex with more edges is joined in shards.
HUB = 500_000


def _with_low(rows: DataFrame, low: DataFrame, hub: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their u; in shards if some u has more than ``hub`` of them (``low`` has their number)."""
    most = low.agg(F.max("n")).first()[0] or 0
    return fragment_replicate_join(rows, low.drop("n"), ["u"], by=["v"]) if most > hub else rows.join(low.drop("n"), "u")


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b", most_rounds: int = 50, hub: int = HUB) -> DataFrame:
    """(id, group): for every id in ``pairs`` the smallest id that it is connected with.

    Alternates large-star and small-star steps until nothing changes; each step is a grouped aggregate and a join,
    and its result is written to the checkpoint folder. Nulls are left out, repeated pairs and loops don't matter, and
    no pairs give no rows. Fails if ``most_rounds`` rounds don't suffice (they take in the order of log2 of the path
    lengths). A star's centre is found by a combined minimum, and a vertex with more than ``hub`` edges is joined in
    shards, so that no hub is gathered in one task.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loose = pairs.select(F.explode(F.array(a, b)).alias("id")).filter("id IS NOT NULL").distinct()
    for _ in range(most_rounds):
        # large star: larger neighbours of u point to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both.filter("v > u"), low, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of u, and u, point to the smallest of them
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_low(large, low, hub)
        after = joined.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = cut(after)
        same = after.count() == edges.count() and not after.exceptAll(edges).take(1)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return loose.join(edges.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left").select("id", F.coalesce("group", "id").alias("group"))
