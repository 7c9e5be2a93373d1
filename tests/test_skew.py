import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.operators.skew import fragment_replicate_join, join_shards, pack, pair_counts, plan_load, self_join_shards, spread

SCHEMA = "id string, k1 string, k2 string, t1 string, t2 string, w double, _h string, n_rows long"


def rows(n=3000, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if r.random() < 0.5 else None if r.random() < 0.2 else f"k{r.randrange(50)}"
        out.append((r.choice([None, f"e{r.randrange(n // 2)}"]), k, r.choice(["a", "a", "b", "", None]), r.choice([None, "t1", f"t{r.randrange(40)}"]), r.choice([None, "t1"]), r.choice([None, 0.0, 0.5, 2.0]), "x", 9))
    return out


def expected(data):
    g = defaultdict(list)
    for x in data:
        g[x[1], x[2]].append(x)
    out = {}
    for k, v in g.items():
        w = [x[5] for x in v if x[5] is not None]
        out[k] = (len(v), len({x[0] for x in v} - {None}), len({(0, x[3]) for x in v if x[3] is not None} | {(1, x[4]) for x in v if x[4] is not None}), round(sum(w) / len(w), 9) if w else None)
    return out


def counts(df):
    c = pair_counts(df, ["k1", "k2"], "id", ["t1", "t2"], "w")
    return {(r.k1, r.k2): (r.n_rows, r.n_ids, r.n_targets, None if r.mean_weight is None else round(r.mean_weight, 9)) for r in c.collect()}


def test_pair_counts_equal_brute_force(spark):
    data = rows()
    assert counts(spark.createDataFrame(data, SCHEMA)) == expected(data)


def test_pair_counts_of_nothing_and_of_nulls(spark):
    assert counts(spark.createDataFrame([], SCHEMA)) == {}
    nothing = [(None,) * 8] * 3
    assert counts(spark.createDataFrame(nothing, SCHEMA)) == {(None, None): (3, 0, 0, None)}


def test_hot_key_is_split_in_proportion(spark):
    df = spark.createDataFrame([("hot",)] * 900 + [(f"k{i}",) for i in range(100)], "k string")
    plan = plan_load(df, ["k"], tasks=8)
    ((_, shards),) = plan.split.values()
    assert 25 <= shards <= 32
    load = [0] * 8
    for t in plan.task_of[plan.buckets :]:
        load[t] += 1
    assert max(load) - min(load) <= 1


def test_pack_takes_the_largest_first():
    to = pack([5, 5, 4, 3, 3], 2)
    sums = [sum(n for n, t in zip([5, 5, 4, 3, 3], to) if t == i) for i in range(2)]
    assert max(sums) <= 11


def test_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(400)] + [(None, 1), ("rare", 7), ("rare", 7), ("none", 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "A"), ("hot", "B"), ("rare", "C"), (None, "D")], "k string, y string")
    got = sorted(map(tuple, fragment_replicate_join(left, right, ["k"], tasks=4).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    assert fragment_replicate_join(left.limit(0), right, ["k"]).count() == 0


def test_a_hot_key_without_other_values_is_dealt_evenly(spark, tmp_path):
    """Rows of the hot key are all the same, so nothing but their number can tell them apart."""
    spark.createDataFrame([("hot", "same")] * 4000 + [(f"k{i}", "same") for i in range(1000)], "k string, x string").write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    plan = plan_load(left, ["k"], tasks=8)
    ((first, shards),) = plan.split.values()
    sent = spread(left.withColumn("_deal", F.monotonically_increasing_id()), ["k"], ["_deal"], plan)
    per_shard = [r["count"] for r in sent.filter("k = 'hot'").groupBy("_shard").count().collect()]
    assert len(per_shard) == shards and max(per_shard) <= 1.4 * 4000 / shards
    right = spark.createDataFrame([("hot", "A"), ("k1", "B")], "k string, y string")
    got = {(r.k, r.y): r["count"] for r in fragment_replicate_join(left, right, ["k"], tasks=8).groupBy("k", "y").count().collect()}
    assert got == {("hot", "A"): 4000, ("k1", "B"): 1}
    assert fragment_replicate_join(left, right, ["k"], tasks=8, by=["x"]).count() == 4001


def test_shards_bring_every_pair_together_once(spark):
    df = spark.createDataFrame([("hot", i) for i in range(60)] + [("b", 100), ("b", 101), (None, 5)], "k string, x int")
    arranged = self_join_shards(df, ["k"], ["x"], tasks=4)
    r = arranged.withColumn("p", F.spark_partition_id()).collect()
    met = [(a.x, b.x) for a in r if a.asks for b in r if b.answers and (a.p, a._h, a._shard) == (b.p, b._h, b._shard)]
    hot, b = range(60), (100, 101)
    assert sorted(met) == sorted([(x, y) for x in hot for y in hot] + [(x, y) for x in b for y in b])
    both = join_shards(df.filter("x < 30"), df, ["k"], ["x"], tasks=4).withColumn("p", F.spark_partition_id()).collect()
    met = [(a.x, c.x) for a in both if a.asks for c in both if not c.asks and (a.p, a._h, a._shard) == (c.p, c._h, c._shard)]
    assert sorted(met) == sorted((x, y) for x in range(30) for y in range(60))
