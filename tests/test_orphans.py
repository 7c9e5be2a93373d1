from datetime import datetime

from loomgraph.operators.orphans import orphans

E = "id string, source_chunk_id string, target_chunk_id string, source_entity_id string, target_entity_id string, created_at timestamp, kind string, key string"
N = "id string, created_at timestamp, first_at string"
D = "record_id string, record_kind string, deleted_at timestamp"
T = [datetime(2024, m, 1) for m in range(1, 13)]


def found(spark, edges, chunks=(), entities=(), deletions=()):
    df = orphans(spark.createDataFrame([(*e, "x", "y") for e in edges], E), spark.createDataFrame([(*c, "z") for c in chunks], N), spark.createDataFrame([(*c, "z") for c in entities], N), spark.createDataFrame(list(deletions), D))
    return {(r.edge_id, r.ref_column) for r in df.collect()}


U = "0aa00000-0000-4000-8000-0000000000bb"


def test_missing_deleted_and_late(spark):
    edges = [
        ("ok", "c1", None, None, "n1", T[5]), ("missing", "gone", "c1", None, None, T[5]), ("deleted", "c2", None, None, None, T[5]), ("again", "c3", None, None, None, T[5]),
        ("late", None, "c4", None, None, T[5]), ("late_no_time", None, "c4", None, None, None), ("other_kind", None, None, "c1", None, T[5]), ("blank", " ", "", "{}", None, T[5]), ("odd", f" {{{U.upper()}}} ", None, None, None, T[5]),
    ]
    chunks = [("c1", T[0]), ("c2", T[0]), ("c3", T[0]), ("c3", T[4]), ("c4", T[6]), ("c4", T[8]), (U, T[1]), (None, T[0])]
    deletions = [("c2", "chunk", T[2]), ("c3", "chunk", T[2]), ("n1", "chunk", T[2]), (None, "chunk", T[2])]
    got = found(spark, edges, chunks, [("n1", T[0])], deletions)
    assert got == {("missing", "source_chunk_id"), ("deleted", "source_chunk_id"), ("late", "target_chunk_id"), ("other_kind", "source_entity_id")}


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [("e", "a", None, None, "b", T[0])] * 2) == {("e", "source_chunk_id"), ("e", "target_entity_id")}


def test_parent_without_time_is_neither_late_nor_deleted(spark):
    assert found(spark, [("e", "c", None, None, None, T[0])], [("c", None)], (), [("c", "chunk", T[1])]) == set()


def test_many_bad_keys_are_joined_in_shards(spark):
    """The way beyond the bound of the broadcast gives the same rows, also where one missing parent has most references."""
    edges = [(f"e{i}", "gone" if i % 3 else f"g{i}", "c1", None, "n1" if i % 2 else "late", T[5]) for i in range(300)]
    tables = [spark.createDataFrame([(*e, "x", "y") for e in edges], E), spark.createDataFrame([("c1", T[0], "z")], N), spark.createDataFrame([("n1", T[0], "z"), ("late", T[7], "z")], N), spark.createDataFrame([], D)]
    few, many = ({(r.edge_id, r.ref_column) for r in orphans(*tables, broadcast_rows=n).collect()} for n in (1000, 0))
    assert many == few and len(few) == 300 + 150
