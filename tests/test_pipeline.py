import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.facade import GraphStore
from loomgraph.functions import metadata
from loomgraph.operators import chunkers, documents, entities, relations
from loomgraph.plans.ingest import Pipeline
from loomgraph.schema import QueryConfig


def texts(spark, *t):
    return spark.createDataFrame([(i, "b", x) for i, x in enumerate(t)], "doc int, base_path string, text string")


def test_sentences(spark):
    df = texts(spark, "Boats came in at dusk. Rain fell on them all. Nobody left town.", "  ", None, "é a. |b. ")
    got = sorted(map(tuple, chunkers.sentence_chunks(df, "text", 2).select("doc", "content", "path", "start_pos", "end_pos", "chunk_index").collect()))
    assert got[:2] == [(0, "Boats came in at dusk. Rain fell on them all.", "b.chunk0", 0, 45, 0), (0, "Nobody left town.", "b.chunk1", 45, 62, 1)]
    assert sorted(got[2:], key=lambda g: g[5]) == [(3, "é a. ", "b.chunk0", 0, 6, 0), (3, "b. ", "b.chunk1", 6, 9, 1)]
    with pytest.raises(ValueError):
        chunkers.sentence_chunks(df, "text", 0)


def test_paragraphs_keep_ordinals(spark):
    df = texts(spark, "one\n\n  \n\nthree", "A first.\n\nThe last.", None)
    got = sorted(map(tuple, chunkers.paragraph_chunks(df, "text").select("doc", "content", "path", "start_pos", "end_pos").collect()))
    assert got == [(0, "one", "b.para0", 0, 3), (0, "three", "b.para2", 5, 10), (1, "A first.", "b.para0", 0, 8), (1, "The last.", "b.para1", 10, 19)]


def test_semantic_cuts():
    v = np.array([[1, 0], [1, 0], [0, 1], [0, 1]], float)
    assert chunkers.semantic_cuts([5, 5, 5, 5], v, 100, 0.7) == [(0, 2), (2, 4)]
    assert chunkers.semantic_cuts([5, 5, 500, 5], np.ones((4, 2)), 100, 0.7) == [(0, 2), (2, 3), (3, 4)]
    assert chunkers.semantic_cuts([], np.zeros((0, 2)), 100, 0.7) == []


def test_citations(spark):
    df = spark.createDataFrame([("a", "See [1] and [42]; (Smith 2020), (Jones et al. 2019), Section 3.2 and chapter 5; doi:10.5555/tide.7 https://a.example/b"), ("b", None), ("c", "none")], "id string, content string")
    got = {(r.citation_pattern, r.reference_id, r.reference_year) for r in relations.citations(df, "id").collect()}
    assert got == {("numeric_citation", "1", None), ("numeric_citation", "42", None), ("author_year_citation", "Smith", "2020"), ("author_year_citation", "Jones et al.", "2019"), ("section_reference", "3.2", None), ("section_reference", "5", None), ("inline_section_reference", "3.2", None), ("doi_reference", "10.5555/tide.7", None), ("url_reference", None, None)}


def test_cooccurrence_weights(spark):
    m = spark.createDataFrame([("c", 0, 0), ("c", 1, 30), ("d", 0, 0), ("d", 1, 200), ("e", 0, 50), ("e", 1, 149), ("e", 2, 50)], "chunk_id string, pos int, start int")
    got = sorted((r.chunk_id, r.a, r.b, round(r.weight, 3)) for r in relations.cooccurrence(m).collect())
    assert got == [("c", 0, 1, 0.85), ("e", 0, 1, 0.505), ("e", 0, 2, 1.0), ("e", 1, 2, 0.505)]


def test_upsert_keeps_id_and_takes_last_metadata(spark):
    s = "id string, name string, entity_type string, metadata string, created_at timestamp"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    old = spark.createDataFrame([("1", "Mara Venn", "PERSON", '{"age":30}', at(1)), ("9", "Kept", "ORG", "{}", at(1))], s)
    new = spark.createDataFrame([("2", "Mara Venn", "PERSON", '{"age":31}', at(2)), ("3", "Mara Venn", "PERSON", None, at(3)), ("4", "New", "ORG", "x", at(3)), ("5", "New", "ORG", "y", at(4)), ("6", None, "ORG", "y", at(4))], s)
    got = {r.name: (r.id, r.metadata) for r in entities.upsert_entities(old, new).collect()}
    assert got == {"Mara Venn": ("1", None), "Kept": ("9", "{}"), "New": ("4", "y")}


@pytest.mark.parametrize("path,title", [("/a/report.pdf", "report"), ("noext", "noext"), ("/x/.env", ".env"), ("/x/a.b.c", "a.b"), ("日本.txt", "日本")])
def test_titles(spark, path, title):
    assert spark.createDataFrame([(path,)], "p string").select(documents.title_of(F.col("p"))).first()[0] == title


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two", encoding="utf-8")
    r = documents.documents_from_files(spark, str(tmp_path)).collect()
    assert [(x.title, x.content) for x in r] == [("a", "line one\nline two")]


def test_metadata():
    assert metadata.loads(metadata.dumps({"a": {"b": [1, None]}})) == {"a": {"b": [1, None]}}
    assert metadata.dumps(None) == "{}" and metadata.loads(None) == {} and metadata.loads("null") == {}
    for bad in ("[1]", '{"a"'):
        with pytest.raises((TypeError, ValueError)):
            metadata.loads(bad)
    with pytest.raises(TypeError):
        metadata.dumps([1])


def test_store_ingests_searches_and_versions(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError):
        store.process_and_insert(spark.createDataFrame([], "id long, rid string, title string, source string, metadata string, content string"))
    store.use_default_pipeline()
    docs = [(1, "r1", "AI Basics", "s", "{}", "Artificial intelligence studies agents. The Turing Institute near London met Alan Turing and Grace Hopper there."), (2, "r2", "Cooking", "s", "{}", "Bread needs flour. Soup needs water."), (3, "r3", "Empty", "s", "{}", " ")]
    store.process_and_insert(spark.createDataFrame(docs, "id long, rid string, title string, source string, metadata string, content string"), link_mentions=True)
    assert store.save() == 1
    again = GraphStore(spark, str(tmp_path / "s"))
    again.use_default_pipeline()
    assert again.tables["documents"].count() == 3 and again.tables["chunks"].filter("document_id = 3").count() == 0
    hit = again.search("Bread needs flour.", QueryConfig(top_k=1, similarity_threshold=0.1)).first()
    assert again.tables["chunks"].filter(F.col("id") == hit.id).first().document_id == 2
    assert again.tables["entities"].count() > 0 and again.tables["edges"].filter("source_chunk_id IS NOT NULL").count() > 0
    assert again.document_scoped_search("bread", ["r2"]).count() == 0
    with pytest.raises(KeyError):
        again.bfs_traversal("nowhere")
    start = again.tables["chunks"].first().id
    assert [r.id for r in again.bfs_traversal(start, 0).collect()] == [start]


def test_stream_of_documents(spark, tmp_path):
    from loomgraph.streaming.ingest import ingest_stream, read_documents

    s = "id long, rid string, title string, source string, metadata string, content string"
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "r1", "t", "s", "{}", "One sentence. Two sentences.")], s).write.parquet(folder)
    q = ingest_stream(read_documents(spark, folder), str(tmp_path / "out"), Pipeline.default(), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert GraphStore(spark, str(tmp_path / "out")).tables["documents"].count() == 1


DOC = "id long, rid string, title string, source string, metadata string, content string"


def test_a_stream_on_a_store_that_has_versions_loses_nothing(spark, tmp_path):
    from loomgraph.streaming.ingest import ingest_stream, read_documents

    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    store = GraphStore(spark, root)
    store.use_default_pipeline()
    assert store.process_and_insert(spark.createDataFrame([(1, "r1", "t", "s", "{}", "One here. Two here.")], DOC)) > 0
    assert store.save() == 1 and store.save() == 2
    spark.createDataFrame([(2, "r2", "t", "s", "{}", "Three here."), (9, "r9", "t", "s", "{}", "")], DOC).write.parquet(folder)
    run = lambda: ingest_stream(read_documents(spark, folder), root, Pipeline.default(), str(tmp_path / "ck"), "feed").start()
    q = run()
    q.processAllAvailable()
    q.stop()
    spark.createDataFrame([(3, "r3", "t", "s", "{}", "Four here.")], DOC).write.mode("append").parquet(folder)
    q = run()
    q.processAllAvailable()
    q.stop()
    after = GraphStore(spark, root)
    assert sorted(r.id for r in after.tables["documents"].collect()) == [1, 2, 3]
    assert after.tables["chunks"].select("document_id").distinct().count() == 3
    # a batch that runs again after a failure publishes nothing
    at = after.manifest["version"]
    assert after.versions.save(added={"chunks": after.tables["chunks"]}, batch=("feed", after.manifest["batches"]["feed"])) == at
    assert GraphStore(spark, root).tables["chunks"].count() == after.tables["chunks"].count()


def test_saves_append_and_of_two_writers_none_is_lost(spark, tmp_path):
    from loomgraph.sources.store import ConcurrentChange

    root = str(tmp_path / "s")
    doc = lambda i: spark.createDataFrame([(i, f"r{i}", "t", "s", "{}", f"Text {i} is here.")], DOC)
    plain = Pipeline.default()
    plain.extract = plain.relate = None
    one, two = GraphStore(spark, root), GraphStore(spark, root)
    for store, i in ((one, 1), (two, 2)):
        store.set_pipeline(plain)
        store.process_and_insert(doc(i))
    assert one.save() == 1 and two.save() == 2
    both = GraphStore(spark, root)
    assert both.tables["documents"].count() == 2 and len(both.manifest["tables"]["chunks"]) == 2 and "entities" not in both.manifest["tables"]
    first = both.manifest["tables"]["chunks"][0]
    one, two = GraphStore(spark, root), GraphStore(spark, root)
    for store in (one, two):
        store.delete_documents(spark.createDataFrame([("r1",)], "rid string"))
    one.save()
    with pytest.raises(ConcurrentChange):
        two.save()
    last = GraphStore(spark, root)
    assert [r.id for r in last.tables["documents"].collect()] == [2] and first not in last.manifest["tables"]["chunks"]
    last.set_pipeline(plain)
    last.process_and_insert(doc(5))
    last.save()
    last.versions.compact()
    assert all(len(f) == 1 for f in last.versions.manifest()["tables"].values()) and GraphStore(spark, root).tables["documents"].count() == 2


def test_documents_get_ids_and_empty_or_known_ones_are_refused(spark):
    store = GraphStore(spark)
    store.use_default_pipeline()
    s = "title string, source string, metadata string, content string"
    n = store.process_and_insert(spark.createDataFrame([("a", "s", "{}", "One is here. Two is there."), ("b", None, None, "Three.")], s))
    docs = store.tables["documents"].collect()
    assert n == store.tables["chunks"].count() >= 2 and sorted(d.id for d in docs) == [1, 2] and len({d.rid for d in docs}) == 2
    assert {c.path.split(".")[0] for c in store.tables["chunks"].collect()} == {f"doc_{d.rid}" for d in docs}
    for bad in ("", None):
        with pytest.raises(ValueError, match="content is empty"):
            store.process_and_insert(spark.createDataFrame([("c", "s", "{}", "Good."), ("d", "s", "{}", bad)], s))
    with pytest.raises(ValueError, match="there already"):
        store.process_and_insert(spark.createDataFrame([(9, docs[0].rid, "t", "s", "{}", "Again.")], DOC))
    assert store.tables["documents"].count() == 2
    assert store.process_and_insert(spark.createDataFrame([("e", "s", "{}", None)], s), on_empty="skip") == 0


def test_default_relations_and_linking(spark):
    chunks = spark.createDataFrame([("c1", "d.p1", "Mara Venn cites [3] and (Holt 1999)."), ("c2", "d.p2", "nothing")], "id string, path string, content string")
    m = [("c1", 0, "Mara Venn", "PER", 0.9, 0, 9, "e1"), ("c1", 1, "Holt", "PER", 0.8, 25, 29, "e2"), ("c1", 2, "Ostby", "LOC", 0.8, 200, 205, "e3")]
    got = relations.default_relations(chunks, spark.createDataFrame(m, relations.MENTION))
    linked = relations.link_extracted(got, chunks).collect()
    cites = [e for e in linked if e.edge_type == "reference"]
    assert len(cites) == 4 and all(e.source_chunk_id == "c1" and e.target_chunk_id is None for e in cites)
    assert sorted(e.weight for e in cites) == [0.7, 0.7, 0.8, 0.9]
    (pair,) = [e for e in linked if e.edge_type == "entity_mention"]
    assert (pair.source_entity_id, pair.target_entity_id, pair.bidirectional, pair.source_chunk_id) == ("e1", "e2", True, None) and pair.weight == 1 - 25 / 200
    assert metadata.loads(pair.metadata)["context"] == "d.p1"


def test_a_relation_extractor_of_the_caller(spark):
    def relate(text, path, entities):
        pairs = [{"source_entity_id": a["entity_id"], "target_entity_id": b["entity_id"], "edge_type": "causal", "weight": 1.0, "bidirectional": False, "metadata": {"n": len(entities)}} for a, b in zip(entities, entities[1:])]
        return [*pairs, {"target_entity_id": entities[0]["entity_id"], "edge_type": "custom", "weight": 0.5, "bidirectional": False, "metadata": {"extracted_from": path}}] if entities else []

    p = Pipeline.default()
    p.relate = relations.per_chunk(relate)
    store = GraphStore(spark)
    store.set_pipeline(p)
    store.process_and_insert(spark.createDataFrame([(1, "r", "t", "s", "{}", "Then Mara Venn saw Holm Bay and Una Lund.")], DOC))
    edges = store.tables["edges"].collect()
    ids = {e.id for e in store.tables["entities"].collect()}
    assert {e.edge_type for e in edges} == {"causal", "custom"} and all({e.source_entity_id, e.target_entity_id} <= ids | {None} for e in edges)
    (custom,) = [e for e in edges if e.edge_type == "custom"]
    assert custom.source_chunk_id == store.tables["chunks"].first().id


def test_clusters_on_disk_are_read_by_partition(spark, tmp_path):
    from loomgraph.operators.vector import ClusterIndex, top_k

    r = np.random.default_rng(1)
    rows = [(str(i), [float(x) for x in r.standard_normal(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = ClusterIndex(df, 8, folder=str(tmp_path / "ivf"))
    hit = index.top_k(rows[3][1], 3, -1.0, probes=8)
    assert [x.id for x in hit.collect()] == [x.id for x in top_k(df, rows[3][1], 3, -1.0).collect()]
    plan = index.top_k(rows[3][1], 3, -1.0, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan and index.top_k(rows[3][1], 1, -1.0, probes=1).first().id == "3"
