import numpy as np

from loomgraph.llm import knn

SCHEMA = "id string, embedding array<float>, near string, h long, cell int, name string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "n", 1, 2, "x") for i, v in rows], SCHEMA)


def run(spark, rows, k=5, dim=64):
    return {r.id: list(zip(r.near, r.cos)) for r in knn.nearest(table(spark, rows), "id", "embedding", k, dim).collect()}


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((60, 64))
    x = np.concatenate([c + 0.25 * r.standard_normal((r.integers(5, 60), 64)) for c in centres]) * r.uniform(0.1, 9, (1, 1))
    x[100:110] = x[90:100] * 3
    rows = [(f"{i:05}", v) for i, v in enumerate(x)]
    got = run(spark, rows)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len({n for n, _ in got[f"{i:05}"]} & {f"{j:05}" for j in w}) for i, w in enumerate(want))
    assert len(got) == len(x) and hits >= 0.95 * want.size
    for i in range(0, len(x), 37):
        for n, c in got[f"{i:05}"]:
            assert abs(c - s[i, int(n)]) < 1e-9


def test_unusable_vectors_repeats_and_few(spark):
    e = lambda *at: [1.0 if i in at else 0.0 for i in range(64)]
    rows = [("a", e(0)), ("a", e(0)), ("b", e(0, 1)), ("c", e(2)), ("nul", None), ("short", [1.0] * 3), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [0.0] * 63), (None, e(5)), ("", e(0, 2))]
    got = run(spark, rows)
    assert set(got) == {"a", "b", "c", ""}
    assert [n for n, _ in got["a"]][:2] == ["", "b"] or [n for n, _ in got["a"]][:2] == ["b", ""]
    assert {n for n, _ in got["c"]} == {"a", "b", ""}
    assert run(spark, []) == {} and run(spark, [("z", [0.0] * 64)]) == {}
    assert run(spark, [("only", e(1))]) == {"only": []} or run(spark, [("only", e(1))]) == {}


def test_many_copies(spark):
    r = np.random.default_rng(6)
    v = r.standard_normal(64)
    rows = [(f"c{i:03}", v) for i in range(40)] + [(f"x{i}", r.standard_normal(64)) for i in range(10)]
    got = run(spark, rows)
    assert [n for n, _ in got["c039"]] == [f"c{i:03}" for i in range(5)] and [n for n, _ in got["c000"]] == [f"c{i:03}" for i in range(1, 6)]
    assert len(got) == 50 and all(len(n) == 5 for n in got.values())


def test_squares_of_a_large_cell_meet_everything(spark, monkeypatch):
    r = np.random.default_rng(7)
    cells = knn.Cells(np.eye(64, dtype=np.float32)[:1], 1, 1.0)
    import pyarrow as pa

    x = r.standard_normal((200, 64)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}".encode() for i in range(200)]), pa.array(list(x), pa.list_(pa.float32())), pa.array(r.integers(0, 2**31, 200))], ["id", "embedding", "h"])
    out = pa.Table.from_batches(list(knn._router(cells, np.array([3]), 64)(iter([batch])))).to_pandas()
    met = {}
    for _, g in out.groupby("cell"):
        for q in g[g["asks"]]["id"]:
            met.setdefault(q, []).extend(g[g["answers"]]["id"])
    assert len(met) == 200 and all(sorted(m) == sorted(f"{i}".encode() for i in range(200)) for m in met.values())


def test_a_vector_asks_in_all_of_its_dense_cloud():
    r = np.random.default_rng(8)
    cloud = r.standard_normal(64) + 0.45 * r.standard_normal((6000, 64))
    x = np.concatenate([cloud, r.standard_normal((12000, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    # each of the sample stands for a hundred: the cloud is planned for 600,000 vectors
    cells = knn.Cells(x[r.permutation(len(x))], 4500, 100.0)
    home, asked = cells.of(x)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -2
    near = np.argsort(-s, axis=1)[:, :5]
    met = (home[near][:, :, None] == asked[:200][:, None, :]).any(axis=2)
    assert met.mean() >= 0.99


def test_ids_survive_packing(spark):
    ids = ["0aa00000-0000-4000-8000-0000000000bb", "", "x", "0AA00000-0000-4000-8000-0000000000BB", "äöü" * 9, "00000000-0000-0000-0000-000000000000"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(knn.unpack_id(knn.pack_id(F.col("id")))).collect()] == ids


def test_exact_mode_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 60)
    r = np.random.default_rng(9)
    x = np.concatenate([c + 0.6 * r.standard_normal((70, 64)) for c in r.standard_normal((4, 64))]).astype(np.float32)
    df = table(spark, [(f"{i:04}", v) for i, v in enumerate(x)])
    got = {q.id: list(q.near) for q in knn.nearest(df, "id", "embedding", exact=True).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {f"{i:04}": [f"{j:04}" for j in np.argsort(-row)[:5]] for i, row in enumerate(s)}


def test_fewer_anchors_lose_nothing_much(spark):
    """A bound on anchors makes cells larger, not answers fewer."""
    r = np.random.default_rng(10)
    x = np.concatenate([c + 0.3 * r.standard_normal((40, 64)) for c in r.standard_normal((40, 64))])
    df = table(spark, [(f"{i:05}", v) for i, v in enumerate(x)])
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    got = {q.id: set(q.near) for q in knn.nearest(df, "id", "embedding", most_anchors=4).collect()}
    assert sum(len(got[f"{i:05}"] & {f"{j:05}" for j in w}) for i, w in enumerate(want)) >= 0.95 * want.size


def test_a_dense_cell_is_divided_among_tasks():
    answers = np.array([15_000.0] + [40.0] * 500)
    sides, task_of = knn.plan_units(answers, answers * 3, 12)
    work = answers * answers * 3 + knn.ROW * answers * 4
    load = np.zeros(12)
    np.add.at(load, task_of, np.repeat(work / sides**2, sides**2))
    assert len(task_of) == (sides**2).sum() and load.max() <= 1.5 * work.sum() / 12 and sides[1:].max() == 1
