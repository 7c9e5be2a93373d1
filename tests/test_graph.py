"""Goldens of hierarchy, traversal and retrieval, and random graphs against a plain sequential model."""

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chunks as C
from loomgraph.operators import edges as E
from loomgraph.operators import retrieve, traverse, vector
from loomgraph.operators.components import components
from loomgraph.plans.fixtures import view
from loomgraph.schema import QueryConfig

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CONFIG = QueryConfig(top_k=5, similarity_threshold=0.0)


def paths(spark, names):
    return spark.createDataFrame([(n, n) for n in names], "id string, path string")


HIER = ["root"] + [f"root.section{i}" for i in (1, 2, 3)] + [f"root.section{i}.para{j}" for i in (1, 2) for j in (1, 2)]


@pytest.mark.parametrize("path,want", [("root.section1", ["root.section2", "root.section3"]), ("root.section1.para1", ["root.section1.para2"]), ("root", []), ("root.section2.para1", ["root.section2.para2"])])
def test_siblings(spark, path, want):
    assert [r.id for r in C.siblings(paths(spark, HIER), path).collect()] == want


def test_descendants_and_ancestors_include_self(spark):
    p = paths(spark, ["root", "root.section1", "root.section2", "root.section1.para1"])
    assert [C.descendants(p, x).count() for x in ("root", "root.section1", "root.section1.para1")] == [4, 2, 1]
    assert [C.ancestors(p, x).count() for x in ("root.section1.para1", "root.section1", "root")] == [3, 2, 1]


def test_label_order_and_sets(spark):
    p = paths(spark, ["a-b", "a.b", "a"])
    assert [r.id for r in C.descendants(p, "a").collect()] == ["a", "a.b"]
    h = C.hierarchy(p.select(F.col("id").alias("seed"), "path"), p, True, True, True)
    got = sorted((r.seed, r.id, r.src) for r in h.collect())
    assert ("a", "a-b", "sibling") in got and ("a", "a", "ancestor") in got and ("a", "a", "descendant") in got and ("a.b", "a", "ancestor") in got
    assert C.hierarchy(p.select(F.col("id").alias("seed"), "path"), p, False, False, False).count() == 0


def edge(i, a, b, t="reference", w=1.0, bi=False, at=0):
    return (i, a, b, None, None, t, w, bi, at)


EDGE = "id string, source_chunk_id string, target_chunk_id string, source_entity_id string, target_entity_id string, edge_type string, weight double, bidirectional boolean, created_seq long"


def model_bfs(start, adj, hops):
    seen, queue, out = {start}, [(start, 0, [start])], []
    while queue:
        n, d, p = queue.pop(0)
        out.append((n, d, p))
        if d < hops:
            for m in adj.get(n, ()):
                if m not in seen:
                    seen.add(m)
                    queue.append((m, d + 1, [*p, m]))
    return out


def model_dfs(start, adj, hops):
    seen, out = set(), []

    def go(n, d, p):
        seen.add(n)
        out.append((n, d, p))
        if d < hops:
            for m in adj.get(n, ()):
                if m not in seen:
                    go(m, d + 1, [*p, m])

    go(start, 0, [start])
    return out


@pytest.mark.parametrize("seed,direction", [(1, "out"), (2, "both")])
def test_random_graphs_match_the_sequential_model(spark, seed, direction):
    r = random.Random(seed)
    nodes = [f"c{i}" for i in range(14)]
    e = [edge(f"e{i:03}", r.choice(nodes), r.choice([*nodes, "gone", None]), w=r.choice([None, 0.0, 0.5, 1.0]), bi=r.random() < 0.4, at=r.randrange(5)) for i in range(36)]
    order = sorted(e, key=lambda x: (x[6] is not None, -(x[6] or 0), x[8], x[0]))
    adj = {}
    for x in order:
        if x[2] in nodes:
            adj.setdefault(x[1], []).append((x, x[2]))
        if direction == "both" and x[7] and x[2] is not None:
            adj.setdefault(x[2], []).append((x, x[1]))
    key = lambda x: (x[6] is not None, -(x[6] or 0), x[8], x[0])
    adj = {n: [m for _, m in sorted(v, key=lambda y: key(y[0]))] for n, v in adj.items()}
    chunks = spark.createDataFrame([(n,) for n in nodes], "id string")
    steps = traverse.adjacency(spark.createDataFrame(e, EDGE), direction=direction, time="created_seq")
    seeds = spark.createDataFrame([("c0", "c0"), ("c1", "c1"), ("zz", "zz")], "seed string, id string")
    found = traverse.bfs(seeds, chunks, steps, 3).collect()
    deep = traverse.dfs(seeds, chunks, steps, 3).collect()
    for s in ("c0", "c1"):
        want = model_bfs(s, adj, 3)
        got = sorted((x for x in found if x.seed == s), key=lambda x: (x.distance, x.ord))
        assert [(x.id, x.distance, x.path) for x in got] == want
        got = sorted((x for x in deep if x.seed == s), key=lambda x: x.ord)
        assert [(x.id, x.distance, x.path) for x in got] == model_dfs(s, adj, 3)
    assert not [x for x in found if x.seed == "zz"]


def test_neighbours_loop_and_types(spark):
    chunks = spark.createDataFrame([("s",), ("t1",), ("t2",)], "id string")
    e = spark.createDataFrame([edge("a", "s", "t1"), edge("b", "s", "t2", "semantic", bi=True), edge("c", "s", "s"), edge("d", "s", "gone")], EDGE)
    one = spark.createDataFrame([("s", "s")], "seed string, id string")
    n = lambda **k: {r.id for r in traverse.neighbours(one, chunks, traverse.adjacency(e, time="created_seq", **k.pop("a", {})), **k).collect()}
    assert n() == {"s", "t1", "t2"}
    assert n(exclude_self=True) == {"t1", "t2"}
    assert n(a={"edge_types": ["semantic"]}) == {"t2"}
    with pytest.raises(ValueError):
        traverse.adjacency(e, direction="in")


def test_walks_enumerate_paths(spark):
    e = spark.createDataFrame([edge("a", "x", "y"), edge("b", "x", "z"), edge("c", "y", "z")], EDGE)
    got = sorted((r.chunk_id, r.depth, r.path) for r in traverse.walks("x", traverse.adjacency(e, time="created_seq"), 3).collect())
    assert got == [("x", 0, ["x"]), ("y", 1, ["x", "y"]), ("z", 1, ["x", "z"]), ("z", 2, ["x", "y", "z"])]


def test_edges_are_checked(spark):
    none = spark.createDataFrame([], EDGE)
    with pytest.raises(ValueError):
        E.insert_edges(none, spark.createDataFrame([edge("a", "x", None)], EDGE))
    with pytest.raises(ValueError):
        E.insert_edges(none, spark.createDataFrame([edge("a", "x", "y", "entity")], EDGE))
    assert E.insert_edges(none, spark.createDataFrame([edge("a", "x", "y")], EDGE)).count() == 1


def test_components_with_a_hub_in_shards(spark):
    pairs = [("a", f"x{i:03d}") for i in range(200)] + [("x000", "y"), ("p", "q"), (None, "q"), ("z", "z")]
    df = spark.createDataFrame(pairs, "id_a string, id_b string")
    whole, shards = ({x.id: x.group for x in components(df, hub=h).collect()} for h in (10_000, 20))
    assert whole == shards and set(whole.values()) == {"a", "p", "z"} and whole["y"] == "a"


def test_components(spark):
    r = random.Random(3)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60) if i % 7] + [("x", "x"), (None, "n001"), ("b", "a"), ("b", "a")]
    r.shuffle(pairs)
    got = {x.id: x.group for x in components(spark.createDataFrame(pairs, "id_a string, id_b string")).collect()}
    want = {}
    for i in range(61):
        if i % 7 or (i and (i - 1) % 7):
            want[f"n{i:03}"] = f"n{(i - 1) // 7 * 7 + 1:03}" if i % 7 == 0 else f"n{i // 7 * 7 + 1:03}"
    assert {k: v for k, v in got.items() if k in want} == want and got["x"] == "x" and got["a"] == got["b"] == "a"


@needs_data
def test_goldens_of_retrieval(spark):
    c, e = view(spark, DATA, "fx_chunks"), view(spark, DATA, "fx_edges")
    assert (c.count(), e.count()) == (511, 1523)
    q = list(spark.read.parquet(f"{DATA}/embeddings.parquet").filter("vec_id = 0").first().embedding)
    top = [(r.id, round(r.score, 6)) for r in retrieve.vector_only(c, q, CONFIG).collect()]
    assert top == [("c0", 1.0), ("c365", 0.369994), ("c334", 0.362722), ("c387", 0.331139), ("c423", 0.296934)]

    def check(rows, n, total, first=()):
        r = rows.collect()
        assert len(r) == n and round(sum(x.score for x in r), 6) == total
        assert [(x.id, round(x.score, 6)) for x in r][: len(first)] == list(first)

    check(retrieve.contextual(c, e, q, CONFIG, "created_seq"), 200, 13.248806, [*top[:4], ("c1", 0.3), ("c5", 0.3)])
    both = replace(CONFIG, include_siblings=False, include_ancestors=True, include_descendants=True)
    check(retrieve.contextual(c, e, q, both, "created_seq"), 20, 4.083646)
    check(retrieve.multi_hop(c, e, q, CONFIG, "created_seq"), 33, 3.933975, [*top, ("c1", 0.15)])
    check(retrieve.hybrid(c, e, q, CONFIG, "created_seq"), 5, 2.4, [("c0", 0.6), ("c36", 0.55), ("c1", 0.5), ("c235", 0.4), ("c255", 0.35)])
    seeds = vector.ranked(vector.top_k(c, q, 5, 0.0)).select("id", "path", "similarity", "rank")
    every = retrieve.hybrid_scores(c, e, seeds, both, "created_seq").orderBy(F.round("score", 9).desc(), "id")
    assert every.count() == 38
    check(every.limit(10), 10, 4.266473, [("c0", 0.8), ("root", 0.5), ("c36", 0.45)])
    wide = vector.ranked(vector.top_k(c, q, 50, 0.0)).select("id", "path", "similarity", "rank")
    check(retrieve.hybrid_scores(c, e, wide, replace(CONFIG, max_hops=1), "created_seq").orderBy(F.round("score", 9).desc(), "id").limit(50), 50, 50.557794, [("c219", 1.4), ("c398", 1.4)])
    check(retrieve.entity_centric(c, e, "n3", replace(CONFIG, top_k=0), "created_seq", order=F.col("chunk_index")), 146, 46.05)
    strict = retrieve.document_scoped(c, e, q, ["doc1", "doc2"], replace(CONFIG, top_k=50, strict_scope=True), "created_seq")
    assert strict.join(c.filter("document_rid IN ('doc1', 'doc2')"), "id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        retrieve.document_scoped(c, e, q, [])


@needs_data
def test_goldens_of_traversal(spark):
    c, e = view(spark, DATA, "fx_chunks"), view(spark, DATA, "fx_edges")
    one = spark.createDataFrame([("c0", "c0")], "seed string, id string")
    steps = traverse.adjacency(e, time="created_seq")
    b = sorted(traverse.bfs(one, c, steps, 3).collect(), key=lambda r: (r.distance, r.ord))
    assert [r.id for r in b] == "c0 c1 c5 c18 c8 c36 c70 c127 c239 c57 c109 c253 c473 c415 c491".split()
    assert next(r.path for r in b if r.id == "c127") == ["c0", "c1", "c18", "c127"]
    f = sorted(traverse.dfs(one, c, steps, 3).collect(), key=lambda r: r.ord)
    assert [r.id for r in f] == "c0 c1 c18 c127 c239 c8 c57 c109 c5 c36 c253 c473 c70 c415 c491".split()


def test_index_choice():
    assert vector.IndexChoice.of("hnsw").params == {"m": 16, "ef_construction": 64}
    assert vector.IndexChoice.of("ivfflat", {"lists": "many"}).params["lists"] == 100
    with pytest.raises(ValueError):
        vector.IndexChoice.of("btree")


def test_cosine_edge_cases(spark):
    from loomgraph.functions.vectors import cosine, cosine_or_zero

    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0], [1.0, 2.0], None), ([0.0, 0.0], [1.0, 0.0], None), (None, [1.0], None), ([float("nan")], [1.0], None), ([None], [1.0], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    for r in df.select("want", cosine(F.col("a"), F.col("b")).alias("c"), cosine_or_zero(F.col("a"), F.col("b")).alias("z")).collect():
        assert (r.c is None) == (r.want is None) and (r.want is None or abs(r.c - r.want) < 1e-9) and r.z == (r.want or 0.0)


def test_a_search_by_threshold_gives_all_hits(spark, monkeypatch):
    from loomgraph.plans import graph_queries as G

    many = spark.range(100_050).select(F.format_string("n%06d", "id").alias("id"), F.lit("p").alias("path"), F.lit("doc1").alias("document_rid"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    monkeypatch.setattr(G, "_chunks", lambda s, d: many)
    monkeypatch.setattr(G, "_vec0", lambda s, d: [1.0, 0.0])
    assert G.vec_threshold(spark, "").count() == 100_050
    assert vector.top_k(many, [1.0, 0.0], 3).count() == 3 and vector.top_k(many, [0.0, -1.0], None, 0.3).count() == 0
