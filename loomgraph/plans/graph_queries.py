"""Queries of the document-graph operators, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths, vectors
from loomgraph.operators import chunkers, chunks, documents, edges, entities, relations, retrieve, traverse, vector
from loomgraph.plans.fixtures import SQL, view, with_views
from loomgraph.plans.ingest import Pipeline, process
from loomgraph.runtime import table
from loomgraph.schema import EDGE_TYPES, QueryConfig

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CONFIG = QueryConfig(top_k=5, similarity_threshold=0.0)
SEQ = "created_seq"


def query(sql: str | None = None, recursive: bool = False, views: bool = True):
    """Registers a query under its function's name with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, recursive) if views and "fx_" in sql else sql
        return f

    return register


class _Source:
    """Where the queries below read: the small clean views, or the given tables with all that is wrong in them."""

    tables = False


def _chunks(s: SparkSession, d: str) -> DataFrame:
    if not _Source.tables:
        return view(s, d, "fx_chunks")
    c = table(s, d, "chunks").filter("id IS NOT NULL").groupBy("id").agg(F.min("document_id").alias("document_id"), F.min("path").alias("path"), F.min("chunk_index").alias("chunk_index"), F.first("embedding", ignorenulls=True).alias("embedding"))
    return chunks.with_rid(c, table(s, d, "doc_records").groupBy("id").agg(F.min("rid").alias("rid")))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges").withColumn(SEQ, F.col("created_at")) if _Source.tables else view(s, d, "fx_edges")


def _vec0(s: SparkSession, d: str) -> list[float]:
    if not _Source.tables:
        return list(table(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])
    usable = table(s, d, "chunks").filter((F.size("embedding") == 64) & vectors.cosine(F.col("embedding"), F.col("embedding")).isNotNull())
    return list(usable.orderBy("id").select("embedding").first()[0])


def _most(s: SparkSession, d: str, column: str, clean: str) -> str:
    """The chunk or entity with the most edges to chunks that are there, or ``clean`` in the views."""
    if not _Source.tables:
        return clean
    there = table(s, d, "chunks").select("id").distinct()
    e = table(s, d, "edges").join(there.select(F.col("id").alias("target_chunk_id")), "target_chunk_id", "left_semi")
    if column == "source_chunk_id":
        e = e.join(there.select(F.col("id").alias(column)), column, "left_semi")
    return e.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


def _node(s: SparkSession, d: str, clean: str) -> str:
    return _most(s, d, "source_chunk_id", clean)


def _entity(s: SparkSession, d: str, clean: str) -> str:
    return _most(s, d, "source_entity_id", clean)


def _target(s: SparkSession, d: str, clean: str) -> str:
    """The entity that most chunks mention, or ``clean`` in the views."""
    if not _Source.tables:
        return clean
    e = table(s, d, "edges").filter("target_entity_id IS NOT NULL AND source_chunk_id IS NOT NULL AND edge_type = 'entity_mention'")
    return e.groupBy("target_entity_id").count().orderBy(F.desc("count"), "target_entity_id").first()[0]


def _rids(s: SparkSession, d: str) -> list[str]:
    if not _Source.tables:
        return ["doc1", "doc2"]
    return [r[0] for r in _chunks(s, d).filter("document_rid IS NOT NULL").select("document_rid").distinct().orderBy("document_rid").limit(2).collect()]


_NODE_SQL = "(SELECT source_chunk_id FROM edges WHERE source_chunk_id IN (SELECT id FROM chunks) AND target_chunk_id IN (SELECT id FROM chunks) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_ENTITY_SQL = "(SELECT source_entity_id FROM edges WHERE source_entity_id IS NOT NULL AND target_chunk_id IN (SELECT id FROM chunks) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


_TARGET_SQL = "(SELECT target_entity_id FROM edges WHERE target_entity_id IS NOT NULL AND source_chunk_id IS NOT NULL AND edge_type = 'entity_mention' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _over_tables(name: str) -> None:
    """Registers ``name`` once more as ``name_tables``, over chunks, edges and doc_records."""
    plan, sql = QUERIES[name], ORACLES[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        _Source.tables = True
        try:
            return plan(s, d)
        finally:
            _Source.tables = False

    # the text after the clean views, with the tables in their place
    recursive = sql.startswith("WITH RECURSIVE ")
    body = sql.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    for view_name in SQL:
        text = f"{view_name} AS ({SQL[view_name]})"
        body = body.replace(text + ", ", "").replace(text, "")
    body = body.replace("fx_chunks", "tb_chunks").replace("fx_edges", "tb_edges").replace("FROM embeddings WHERE vec_id = 0", "FROM (SELECT embedding FROM tb_chunks WHERE embedding IS NOT NULL ORDER BY id LIMIT 1)")
    body = re.sub(r"'c[0135]'", _NODE_SQL, body).replace("target_entity_id = 'n3' AND edge_type", f"target_entity_id = {_TARGET_SQL} AND edge_type").replace("'n3'", _ENTITY_SQL).replace("('doc1', 'doc2')", "(SELECT DISTINCT document_rid FROM tb_chunks WHERE document_rid IS NOT NULL ORDER BY 1 LIMIT 2)")
    body = body.replace("ORDER BY chunk_index, id", "ORDER BY chunk_index NULLS FIRST, id").strip()
    views = ", ".join(f"{v} AS ({SQL[v]})" for v in ("tb_chunks", "tb_edges") if v in body)
    QUERIES[f"{name}_tables"] = run
    ORACLES[f"{name}_tables"] = f"WITH {'RECURSIVE ' if recursive else ''}{views}{' ' if body.startswith('SELECT') else ', '}{body.lstrip(', ')}"


# --- vector search
_COS = "list_cosine_similarity(c.embedding::DOUBLE[], q.e)"
_Q = "(SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) q"
_SCORED = f",, sc AS (SELECT c.id, c.path, c.document_rid, {_COS} AS sim FROM fx_chunks c, {_Q} WHERE c.embedding IS NOT NULL)"
_SEEDS = _SCORED + ", seeds AS (SELECT *, row_number() OVER (ORDER BY round(sim, 9) DESC, id) - 1 AS rank FROM (SELECT * FROM sc WHERE sim >= 0 ORDER BY round(sim, 9) DESC, id LIMIT 5))"


def _sims(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("similarity", 6).alias("similarity"))


@query(_SCORED + "SELECT id, round(sim, 6) AS similarity FROM sc WHERE sim >= 0 ORDER BY round(sim, 9) DESC, id LIMIT 5")
def vec_topk(s, d):
    return _sims(vector.top_k(_chunks(s, d), _vec0(s, d), 5, 0.0))


@query(_SCORED + "SELECT id, round(sim, 6) AS similarity FROM sc WHERE sim >= 0.3 ORDER BY round(sim, 9) DESC, id LIMIT 100000")
def vec_threshold(s, d):
    return _sims(vector.top_k(_chunks(s, d), _vec0(s, d), None, 0.3))


@query(_SCORED + "SELECT id, round(sim, 6) AS similarity FROM sc WHERE sim >= 0 AND document_rid IN ('doc1', 'doc2') ORDER BY round(sim, 9) DESC, id LIMIT 10")
def vec_doc_scoped(s, d):
    return _sims(vector.top_k(_chunks(s, d), _vec0(s, d), 10, 0.0, _rids(s, d)))


@query(_SEEDS + """, near AS (
  SELECT s.id AS seed, s.sim, c.id, c.path, c.id = s.id AS m FROM seeds s JOIN fx_chunks c ON c.path = s.path OR starts_with(s.path, c.path || '.') OR starts_with(c.path, s.path || '.'))
SELECT id, path, round(sim, 6) AS similarity, m AS is_match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m DESC, sim DESC, seed) AS r FROM near) WHERE r = 1""")
def vec_with_context(s, d):
    return vector.top_k_with_context(_chunks(s, d), _vec0(s, d), 5).withColumn("similarity", F.round("similarity", 6))


@query(""",, q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT q.vec_id AS query_id, c.id, list_cosine_similarity(c.embedding::DOUBLE[], q.e) AS sim FROM q, fx_chunks c WHERE c.embedding IS NOT NULL)
SELECT query_id, id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS k FROM r WHERE sim >= 0) WHERE k <= 5""")
def vec_batch_topk(s, d):
    q = table(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.batch_top_k(_chunks(s, d), q, 5, 0.0).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(s, d):
    """The scalar similarity of each vector and the next."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(vectors.cosine_or_zero(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query()
def vec_ivfflat(s, d):
    """The approximate search over clusters (rows only: another engine has other clusters)."""
    return _sims(vector.ClusterIndex(_chunks(s, d), 20).top_k(_vec0(s, d), 5, 0.0, probes=5))


# --- hierarchy
_BELOW = "(path = 'root.s1' OR starts_with(path, 'root.s1.'))"


@query(f"SELECT id, path FROM fx_chunks WHERE {_BELOW}")
def path_descendants(s, d):
    return chunks.descendants(_chunks(s, d), "root.s1").select("id", "path")


@query("SELECT id, path FROM fx_chunks WHERE path IN ('root', 'root.s0', 'root.s0.p0')")
def path_ancestors(s, d):
    return chunks.ancestors(_chunks(s, d), "root.s0.p0").select("id", "path")


@query("SELECT id, path FROM fx_chunks WHERE starts_with(path, 'root.') AND len(string_split(path, '.')) = 2 AND path <> 'root.s3'")
def path_siblings(s, d):
    return chunks.siblings(_chunks(s, d), "root.s3").select("id", "path")


@query("""
WITH s AS (SELECT *, string_split(path, '.') AS l FROM (SELECT id, path FROM chunks GROUP BY ALL)),
up AS (SELECT id AS seed, path AS sp, array_to_string(l[1:k], '.') AS p FROM s, unnest(range(1, len(l) + 1)) t(k)),
par AS (SELECT id, path, array_to_string(l[1:len(l) - 1], '.') AS up, len(l) AS n FROM s)
SELECT src, count(*) AS n_pairs, count(DISTINCT seed) AS n_seeds, count(DISTINCT id) AS n_found FROM (
  SELECT 'ancestor' AS src, up.seed, s.id FROM up JOIN s ON s.path = up.p
  UNION ALL SELECT 'descendant', s.id, up.seed FROM up JOIN s ON s.path = up.p
  UNION ALL SELECT 'sibling', a.id, b.id FROM par a JOIN par b ON a.up = b.up AND a.n = b.n AND a.path <> b.path) GROUP BY 1""")
def hierarchy_sets(s, d):
    """Ancestors, descendants and siblings of every chunk, counted; all chunks are seeds at once."""
    c = table(s, d, "chunks").select("id", "path").distinct()
    h = chunks.hierarchy(c.select(F.col("id").alias("seed"), "path"), c, True, True, True)
    return h.groupBy("src").agg(F.count("*").alias("n_pairs"), F.countDistinct("seed").alias("n_seeds"), F.countDistinct("id").alias("n_found"))


@query("SELECT DISTINCT path, len(string_split(path, '.')) AS nlevel, array_to_string(string_split(path, '.')[1:len(string_split(path, '.')) - 1], '.') AS parent FROM chunks")
def path_functions(s, d):
    p = F.col("path")
    return table(s, d, "chunks").select("path", paths.nlevel(p).cast("long").alias("nlevel"), paths.parent(p).alias("parent")).distinct()


@query("""SELECT src, id FROM (SELECT 'ancestor' AS src, id FROM fx_chunks WHERE path IN ('root', 'root.s1') UNION ALL SELECT 'descendant', id FROM fx_chunks WHERE path = 'root.s1' OR starts_with(path, 'root.s1.')
UNION ALL SELECT 'sibling', id FROM fx_chunks WHERE starts_with(path, 'root.') AND len(string_split(path, '.')) = 2 AND path <> 'root.s1')""")
def hierarchical_context(s, d):
    """All three relations of one path; the path itself is among its ancestors and its descendants."""
    start = s.createDataFrame([("root.s1",)], "path string")
    return chunks.hierarchy(start, _chunks(s, d), True, True, True).select("src", "id")


# --- edges
_E = "SELECT id, edge_type, weight FROM fx_edges WHERE "


@query(_E + "id = 'm7'")
def edge_lookup(s, d):
    return edges.select_edge(_edges(s, d), "m7").select("id", "edge_type", "weight")


@query(_E + "source_chunk_id = 'c0'")
def edges_from(s, d):
    return edges.edges_from_chunk(_edges(s, d), _node(s, d, "c0"), time=SEQ).select("id", "edge_type", "weight")


@query(_E + "target_chunk_id = 'c1' AND edge_type = 'reference'")
def edges_to(s, d):
    return edges.edges_to_chunk(_edges(s, d), _node(s, d, "c1"), "reference", time=SEQ).select("id", "edge_type", "weight")


@query("SELECT id, edge_type, weight, true AS is_outgoing FROM fx_edges WHERE source_chunk_id = 'c5' UNION ALL SELECT id, edge_type, weight, false FROM fx_edges WHERE target_chunk_id = 'c5' AND bidirectional")
def edges_connected(s, d):
    return edges.edges_connected_to_chunk(_edges(s, d), _node(s, d, "c5"), time=SEQ).select("id", "edge_type", "weight", "is_outgoing")


@query(_E + "source_entity_id = 'n3'")
def edges_from_entity(s, d):
    return edges.edges_from_entity(_edges(s, d), _entity(s, d, "n3"), time=SEQ).select("id", "edge_type", "weight")


@query(_E + "target_entity_id = 'n3' AND edge_type = 'entity_mention'")
def edges_to_entity(s, d):
    return edges.edges_to_entity(_edges(s, d), _target(s, d, "n3"), "entity_mention", time=SEQ).select("id", "edge_type", "weight")


@query("SELECT source_chunk_id AS chunk_id, id AS edge_id FROM fx_edges WHERE target_entity_id = 'n3' AND edge_type = 'entity_mention' AND source_chunk_id IS NOT NULL")
def mentions(s, d):
    e = _edges(s, d).withColumn("created_at", F.col(SEQ)).withColumn("metadata", F.lit("{}"))
    return entities.chunks_mentioning(e, _target(s, d, "n3")).select("chunk_id", "edge_id")


_FOR = "SELECT DISTINCT c.id, c.document_rid, c.chunk_index FROM fx_chunks c JOIN fx_edges e ON (e.source_entity_id = 'n3' AND e.target_chunk_id = c.id) OR (e.target_entity_id = 'n3' AND e.source_chunk_id = c.id)"


@query(_FOR)
def chunks_for_entity(s, d):
    return entities.chunks_for_entity(_edges(s, d), _chunks(s, d), _entity(s, d, "n3")).select("id", "document_rid", "chunk_index")


@query("SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('semantic', 'hierarchical', 'reference', 'entity_mention', 'temporal', 'causal', 'custom') AND coalesce(source_chunk_id, source_entity_id) IS NOT NULL AND coalesce(target_chunk_id, target_entity_id) IS NOT NULL GROUP BY 1")
def edges_legal(s, d):
    """The edges that may be inserted, counted by type after insertion into an empty table."""
    e = table(s, d, "edges")
    ok = e.filter(F.col("edge_type").isin(*EDGE_TYPES) & F.coalesce("source_chunk_id", "source_entity_id").isNotNull() & F.coalesce("target_chunk_id", "target_entity_id").isNotNull())
    return edges.insert_edges(e.limit(0), ok).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS n_ids FROM edges WHERE id NOT IN (SELECT id FROM edges WHERE edge_type = 'custom')")
def edges_deleted(s, d):
    e = table(s, d, "edges")
    return edges.delete_edges(e, e.filter("edge_type = 'custom'").select("id")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("SELECT id, CASE WHEN edge_type = 'causal' THEN 0.5 ELSE weight END AS weight FROM (SELECT id, min(edge_type) AS edge_type, min(weight) AS weight FROM edges GROUP BY id)")
def edge_weights_updated(s, d):
    e = table(s, d, "edges").groupBy("id").agg(F.min("edge_type").alias("edge_type"), F.min("weight").alias("weight"))
    return edges.update_edge_weights(e, e.filter("edge_type = 'causal'").select("id", F.lit(0.5).alias("weight"))).select("id", "weight")


# --- traversal
_STEPS = {
    "out": "SELECT source_chunk_id AS a, target_chunk_id AS b FROM fx_edges WHERE source_chunk_id IS NOT NULL AND target_chunk_id IS NOT NULL",
}
_STEPS["both"] = _STEPS["out"] + " UNION ALL SELECT target_chunk_id, source_chunk_id FROM fx_edges WHERE bidirectional AND source_chunk_id IS NOT NULL AND target_chunk_id IS NOT NULL"


def _bfs_sql(direction: str, hops: int, seeds: str) -> str:
    return f""", st AS ({_STEPS[direction]}), reach AS (
  SELECT seed, id, 0 AS depth FROM ({seeds})
  UNION SELECT r.seed, st.b, r.depth + 1 FROM reach r JOIN st ON st.a = r.id JOIN fx_chunks c ON c.id = st.b WHERE r.depth < {hops}),
found AS (SELECT seed, id, min(depth) AS distance FROM reach GROUP BY 1, 2)"""


def _one(s: SparkSession, chunk: str) -> DataFrame:
    return s.createDataFrame([(chunk, chunk)], "seed string, id string")


@query("," + _bfs_sql("out", 3, "SELECT 'c0' AS seed, 'c0' AS id") + "SELECT id, CAST(distance AS INT) AS distance FROM found", recursive=True)
def bfs_out(s, d):
    return traverse.bfs(_one(s, _node(s, d, "c0")), _chunks(s, d), traverse.adjacency(_edges(s, d), time=SEQ), 3).select("id", "distance")


@query("," + _bfs_sql("both", 3, "SELECT 'c0' AS seed, 'c0' AS id") + "SELECT id, CAST(distance AS INT) AS distance FROM found", recursive=True)
def bfs_both(s, d):
    return traverse.bfs(_one(s, _node(s, d, "c0")), _chunks(s, d), traverse.adjacency(_edges(s, d), direction="both", time=SEQ), 3).select("id", "distance")


@query("," + _bfs_sql("out", 2, "SELECT id AS seed, id FROM fx_chunks") + "SELECT CAST(distance AS INT) AS distance, count(*) AS n FROM found GROUP BY 1", recursive=True)
def bfs_all_seeds(s, d):
    """Two hops from every chunk at once."""
    c = _chunks(s, d)
    return traverse.bfs(c.select(F.col("id").alias("seed"), "id"), c, traverse.adjacency(_edges(s, d), time=SEQ), 2).groupBy("distance").agg(F.count("*").alias("n"))


@query(f",, st AS ({_STEPS['both']}), w AS (SELECT 'c0' AS id, 0 AS depth, ['c0'] AS path UNION SELECT st.b, w.depth + 1, list_append(w.path, st.b) FROM w JOIN st ON st.a = w.id WHERE w.depth < 3 AND NOT list_contains(w.path, st.b)) SELECT id AS chunk_id, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path FROM w", recursive=True)
def walk_paths(s, d):
    w = traverse.walks("c0", traverse.adjacency(_edges(s, d), direction="both", time=SEQ), 3)
    return w.select("chunk_id", "depth", F.array_join("path", ">").alias("path"))


@query("SELECT DISTINCT e.target_chunk_id AS id FROM fx_edges e JOIN fx_chunks c ON c.id = e.target_chunk_id WHERE e.source_chunk_id = 'c3'")
def neighbors(s, d):
    return traverse.neighbours(_one(s, _node(s, d, "c3")), _chunks(s, d), traverse.adjacency(_edges(s, d), time=SEQ)).select("id")


@query()
def dfs(s, d):
    """Depth-first order, which SQL can't say; tests compare it with a plain model."""
    return traverse.dfs(_one(s, "c0"), _chunks(s, d), traverse.adjacency(_edges(s, d), time=SEQ), 3).select("id", "distance", "ord")


@query("SELECT CAST(n_out AS BIGINT) AS n_out, count(*) AS n FROM (SELECT source_chunk_id, count(DISTINCT target_chunk_id) AS n_out FROM edges WHERE target_chunk_id IS NOT NULL AND source_chunk_id IS NOT NULL AND target_chunk_id IN (SELECT id FROM chunks) AND source_chunk_id IN (SELECT id FROM chunks) GROUP BY 1) GROUP BY 1")
def out_degrees(s, d):
    """Neighbours of every chunk of the large edge table, as a distribution."""
    c = table(s, d, "chunks").select("id").distinct()
    n = traverse.neighbours(c.select(F.col("id").alias("seed"), "id"), c, traverse.adjacency(table(s, d, "edges")))
    return n.groupBy("seed").agg(F.count("*").alias("n_out")).groupBy("n_out").agg(F.count("*").alias("n"))


# --- retrieval
def _found(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.round("similarity_score", 6).alias("similarity_score"), "graph_distance", "retrieval_method")


_OUT = "id, round(score, 6) AS score, round(sim, 6) AS similarity_score, CAST(dist AS INT) AS graph_distance, m AS retrieval_method"
_SIB = "SELECT s.rank, s.sim, c.id FROM {seeds} s JOIN fx_chunks c ON array_to_string(string_split(c.path, '.')[1:len(string_split(c.path, '.')) - 1], '.') = array_to_string(string_split(s.path, '.')[1:len(string_split(s.path, '.')) - 1], '.') AND len(string_split(c.path, '.')) = len(string_split(s.path, '.')) AND c.path <> s.path"


@query(_SEEDS + f"""SELECT {_OUT} FROM (SELECT id, sim AS score, sim, 0 AS dist, 'vector' AS m FROM seeds)""")
def vector_only(s, d):
    return _found(retrieve.vector_only(_chunks(s, d), _vec0(s, d), CONFIG))


@query(_SEEDS + f""", cand AS (
  SELECT DISTINCT s.rank, 0 AS prio, e.target_chunk_id AS id, s.sim * 0.3 AS score, 1 AS dist, 'graph_neighbor' AS m FROM seeds s JOIN fx_edges e ON e.source_chunk_id = s.id JOIN fx_chunks c ON c.id = e.target_chunk_id
  UNION ALL SELECT rank, 1, id, sim * 0.1, 0, 'hierarchical' FROM ({_SIB.format(seeds='seeds')})),
pick AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, prio) AS k FROM cand WHERE id NOT IN (SELECT id FROM seeds))
SELECT {_OUT} FROM (SELECT id, sim AS score, sim, 0 AS dist, 'vector' AS m FROM seeds UNION ALL SELECT id, score, 0, dist, m FROM pick WHERE k = 1)""")
def contextual(s, d):
    return _found(retrieve.contextual(_chunks(s, d), _edges(s, d), _vec0(s, d), CONFIG, SEQ))


@query(_SEEDS + _bfs_sql("out", 2, "SELECT rank AS seed, id FROM seeds") + f""",
pick AS (SELECT f.id, s.sim * 0.3 / (f.distance + 1) AS score, f.distance, row_number() OVER (PARTITION BY f.id ORDER BY s.rank) AS k FROM found f JOIN seeds s ON s.rank = f.seed WHERE f.distance > 0 AND f.id NOT IN (SELECT id FROM seeds))
SELECT {_OUT} FROM (SELECT id, sim AS score, sim, 0 AS dist, 'vector' AS m FROM seeds UNION ALL SELECT id, score, 0, distance, 'multi_hop' FROM pick WHERE k = 1)""", recursive=True)
def multihop(s, d):
    return _found(retrieve.multi_hop(_chunks(s, d), _edges(s, d), _vec0(s, d), CONFIG, SEQ))


_HYBRID = _bfs_sql("out", 2, "SELECT rank AS seed, id FROM seeds") + f""",
adds AS (SELECT seed AS i, 0 AS kind, distance, id, 0.3 / distance AS amount FROM found WHERE distance > 0
  UNION ALL SELECT rank, 1, 0, id, 0.1 FROM ({_SIB.format(seeds='seeds')})),
every AS (SELECT a.* FROM adds a LEFT JOIN seeds s ON s.id = a.id WHERE s.rank IS NULL OR a.i >= s.rank UNION ALL SELECT -1, 0, 0, id, sim * 0.6 FROM seeds),
total AS (SELECT e.id, sum(amount) AS score, coalesce(max(s.sim), 0) AS sim, arg_min(e.distance, e.i * 1000 + e.kind * 100 + e.distance) AS dist, 'hybrid' AS m FROM every e LEFT JOIN seeds s ON s.id = e.id GROUP BY 1)"""


@query(_SEEDS + _HYBRID + f"SELECT {_OUT} FROM total ORDER BY round(score, 9) DESC, id LIMIT 5", recursive=True)
def hybrid(s, d):
    return _found(retrieve.hybrid(_chunks(s, d), _edges(s, d), _vec0(s, d), CONFIG, SEQ))


@query(_SCORED + ", seeds AS (SELECT *, row_number() OVER (ORDER BY round(sim, 9) DESC, id) - 1 AS rank FROM (SELECT * FROM sc WHERE sim >= 0 AND document_rid IN ('doc1', 'doc2') ORDER BY round(sim, 9) DESC, id LIMIT 10))" + _HYBRID + f"SELECT {_OUT} FROM total ORDER BY round(score, 9) DESC, id LIMIT 10", recursive=True)
def hybrid_scoped(s, d):
    return _found(retrieve.document_scoped(_chunks(s, d), _edges(s, d), _vec0(s, d), _rids(s, d), replace(CONFIG, top_k=10), SEQ))


@query(f",, direct AS (SELECT *, row_number() OVER (ORDER BY chunk_index, id) AS rank FROM ({_FOR}))" + _bfs_sql("out", 2, "SELECT rank AS seed, id FROM direct") + f""",
pick AS (SELECT id, 0.3 / distance AS score, distance, row_number() OVER (PARTITION BY id ORDER BY seed) AS k FROM found WHERE distance > 0 AND id NOT IN (SELECT id FROM direct))
SELECT {_OUT} FROM (SELECT id, 1.0 AS score, 0 AS sim, 0 AS dist, 'entity_centric' AS m FROM direct UNION ALL SELECT id, score, 0, distance, 'entity_fanout' FROM pick WHERE k = 1)""", recursive=True)
def entity_centric(s, d):
    return _found(retrieve.entity_centric(_chunks(s, d), _edges(s, d), _entity(s, d, "n3"), replace(CONFIG, top_k=0), SEQ, order=F.col("chunk_index")))


# --- chunking and relations
@query("""
WITH s AS (SELECT doc_id, string_split(replace(replace(replace(text, '! ', '!|'), '? ', '?|'), '. ', '.|'), '|') AS p FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
g AS (SELECT doc_id, CAST(k AS INT) AS k, array_to_string(p[k * 3 + 1:k * 3 + 3], ' ') AS content FROM s, unnest(range(0, (len(p) - 1) // 3 + 1)) t(k)),
o AS (SELECT *, CAST(sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS e FROM g)
SELECT doc_id, concat('doc_', doc_id, '.chunk', k) AS path, k AS chunk_index, e - CAST(strlen(content) AS INT) AS start_pos, e AS end_pos, md5(content) AS content FROM o""")
def sentence_chunks(s, d):
    t = table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("doc_"), "doc_id").alias("base_path"))
    return chunkers.sentence_chunks(t, "text", 3).select("doc_id", "path", "chunk_index", "start_pos", "end_pos", F.md5("content").alias("content"))


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, CAST(k AS INT) AS k, regexp_replace(p[k + 1], '^\\s+|\\s+$', '', 'g') AS content FROM s, unnest(range(0, len(p))) t(k)),
o AS (SELECT *, CAST(sum(strlen(content) + 2) OVER (PARTITION BY doc_id ORDER BY k) AS INT) - 2 AS e FROM g WHERE content <> '')
SELECT doc_id, concat('doc_', doc_id, '.para', k) AS path, k AS chunk_index, e - CAST(strlen(content) AS INT) AS start_pos, e AS end_pos, md5(content) AS content FROM o""")
def paragraph_chunks(s, d):
    t = table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("doc_"), "doc_id").alias("base_path"))
    return chunkers.paragraph_chunks(t, "text").select("doc_id", "path", "chunk_index", "start_pos", "end_pos", F.md5("content").alias("content"))


@query()
def semantic_chunks(s, d):
    """Sentences grouped by a sequential rule (rows only; tests compare it with a plain model)."""
    t = table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("doc_"), "doc_id").alias("base_path"))
    return chunkers.semantic_chunks(t, "doc_id", "text", 500, 0.7).select("doc_id", "path", "chunk_index", "start_pos", "end_pos")


@query("SELECT id, list_transform(range(384), lambda i: CAST(((strlen(content) + i) % 100) / 100.0 AS FLOAT)) AS embedding FROM (SELECT id, min(content) AS content FROM chunks GROUP BY id)")
def test_embedder(s, d):
    c = table(s, d, "chunks").groupBy("id").agg(F.min("content").alias("content"))
    return chunkers.embed(c, "content", chunkers.length_embedder()).select("id", "embedding")


_CITED = "concat(coalesce(text, ''), ' [7] see (Smith et al. 2019) and (Jones 2020), Section 3.2, chapter 5, Figure 2.1, doi:10.1234/ab https://example.org/', doc_id)"
_PATTERNS = [(k, p.replace("'", "''"), relations._GROUPS[k]) for k, p in relations.CITATIONS.items()]


@query("SELECT citation_pattern, citation_text, reference_id, reference_year, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS citation_pattern, unnest(regexp_extract_all(t, '{p}', 0)) AS citation_text, "
    + (f"unnest(regexp_extract_all(t, '{p}', 1))" if g else "NULL") + " AS reference_id, " + (f"unnest(regexp_extract_all(t, '{p}', 2))" if g > 1 else "NULL") + f" AS reference_year FROM (SELECT {_CITED} AS t FROM documents)"
    for k, p, g in _PATTERNS) + ") GROUP BY ALL")
def citations(s, d):
    t = table(s, d, "documents").select("doc_id", F.expr(_CITED).alias("content"))
    c = relations.citations(t, "doc_id")
    return c.groupBy("citation_pattern", "citation_text", "reference_id", "reference_year").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT document_id AS chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY start_pos, id) - 1 AS pos, start_pos AS st FROM (SELECT id, min(document_id) AS document_id, min(start_pos) AS start_pos FROM chunks GROUP BY id) WHERE start_pos IS NOT NULL)
SELECT a.chunk_id, CAST(a.pos AS INT) AS a, CAST(b.pos AS INT) AS b, abs(a.st - b.st) AS distance, 1 - abs(a.st - b.st) / 200.0 AS weight FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.pos < b.pos AND abs(a.st - b.st) < 100""")
def cooccurrence(s, d):
    """The join of mentions near each other, with the chunks of a document as its mentions."""
    from pyspark.sql import Window as W

    c = table(s, d, "chunks").groupBy("id").agg(F.min("document_id").alias("document_id"), F.min("start_pos").alias("start_pos")).filter("start_pos IS NOT NULL")
    m = c.withColumn("pos", F.row_number().over(W.partitionBy("document_id").orderBy("start_pos", "id")) - 1)
    return relations.cooccurrence(m.select(F.col("document_id").alias("chunk_id"), "pos", F.col("start_pos").alias("start")))


@query("SELECT regexp_replace(entity_type, '^(B-|I-)', '') AS entity_type, count(*) AS n FROM entities GROUP BY 1")
def entity_types(s, d):
    return table(s, d, "entities").select(relations.normal_type(F.col("entity_type")).alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))


@query()
def ingest_counts(s, d):
    """The whole pipeline over doc_records: rows of each table made (rows only: the models are stand-ins)."""
    t = table(s, d, "doc_records").groupBy("id").agg(F.max_by(F.struct("rid", "title", "source", "metadata", "content"), F.struct("updated_at", "content")).alias("r")).select("id", "r.*")
    made = process(t, Pipeline.default(), F.lit("2024-01-01").cast("timestamp"), link_mentions=True)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in sorted(made.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- documents
_DOC = "id, rid, title, source"


@query(f"SELECT {_DOC} FROM doc_records WHERE rid = (SELECT min(rid) FROM doc_records)")
def doc_lookup(s, d):
    t = table(s, d, "doc_records")
    return documents.select_document(t, t.agg(F.min("rid")).first()[0]).select("id", "rid", "title", "source")


@query(f"SELECT {_DOC} FROM doc_records WHERE title ILIKE '%report%' OR source ILIKE '%report%' ORDER BY created_at DESC NULLS FIRST, id LIMIT 20")
def doc_search(s, d):
    return documents.search_documents(table(s, d, "doc_records"), "report", 20).select("id", "rid", "title", "source")


@query(f"SELECT {_DOC} FROM doc_records WHERE created_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' ORDER BY created_at DESC NULLS FIRST, id LIMIT 25")
def doc_page(s, d):
    return documents.select_all_documents(table(s, d, "doc_records"), "2023-01-01 00:00:00", 25).select("id", "rid", "title", "source")


@query("SELECT id, rid, CASE WHEN source = 'upload' THEN 'changed' ELSE title END AS title, source FROM (SELECT id, min(rid) AS rid, min(title) AS title, min(source) AS source FROM doc_records GROUP BY id)")
def doc_update(s, d):
    t = table(s, d, "doc_records").groupBy("id").agg(*[F.min(c).alias(c) for c in ("rid", "title", "source", "metadata", "created_at", "updated_at")])
    changes = t.filter("source = 'upload'").select("rid", F.lit("changed").alias("title"), "source", "metadata")
    return documents.update_documents(t, changes).select("id", "rid", "title", "source")


@query("""SELECT kind, n FROM (SELECT 'documents' AS kind, count(*) AS n FROM doc_records WHERE rid NOT IN (SELECT rid FROM doc_records WHERE source = 'upload')
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM doc_records WHERE rid IN (SELECT rid FROM doc_records WHERE source = 'upload')))""")
def doc_delete(s, d):
    t = table(s, d, "doc_records")
    left, c = documents.delete_documents(t, table(s, d, "chunks"), t.filter("source = 'upload'").select("rid").distinct())
    return left.agg(F.count("*").alias("n")).select(F.lit("documents").alias("kind"), "n").unionByName(c.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), "n"))


@query("""WITH t AS (SELECT max(id) AS top FROM doc_records), n AS (SELECT title, source, metadata, row_number() OVER (ORDER BY title NULLS FIRST, source NULLS FIRST, metadata NULLS FIRST) AS k FROM (SELECT page_title AS title, source, lang AS metadata FROM documents WHERE page_title IS NOT NULL GROUP BY ALL))
SELECT t.top + n.k AS id, n.title, n.source FROM t, n""")
def doc_insert(s, d):
    """Many documents inserted at once, ids running on."""
    new = table(s, d, "documents").filter("page_title IS NOT NULL").select(F.col("page_title").alias("title"), "source", F.col("lang").alias("metadata")).distinct()
    old = table(s, d, "doc_records").select("id", "rid", "title", "source", "metadata", "created_at", "updated_at")
    both = documents.insert_documents(old, new, F.lit("2024-01-01").cast("timestamp"), F.md5("title"))
    return both.join(F.broadcast(old.agg(F.max("id").alias("top"))), F.col("id") > F.col("top")).select("id", "title", "source")


# --- entities
@query("SELECT id, name FROM entities WHERE id = (SELECT min(id) FROM entities)")
def entity_lookup(s, d):
    e = table(s, d, "entities")
    return entities.select_entity(e, e.agg(F.min("id")).first()[0]).select("id", "name")


@query("SELECT id, name, entity_type FROM entities WHERE name = 'Dorothy Steloklorbre' AND entity_type = 'PER'")
def entity_by_name(s, d):
    return entities.select_entity_by_name(table(s, d, "entities"), "Dorothy Steloklorbre", "PER").select("id", "name", "entity_type")


@query("SELECT id, name FROM (SELECT DISTINCT id, name, entity_type FROM entities) WHERE name ILIKE '%museum%' AND entity_type = 'ORG' ORDER BY name, id LIMIT 50")
def entity_search(s, d):
    e = table(s, d, "entities").select("id", "name", "entity_type").distinct()
    return entities.search_entities(e, "museum", "ORG", 50).select("id", "name")


@query("SELECT id, name FROM fx_entities WHERE entity_type = 'NATION' ORDER BY name, id LIMIT 100")
def entities_by_type(s, d):
    return entities.select_entities_by_type(view(s, d, "fx_entities"), "NATION").select("id", "name")


@query("""
WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, entity_type ORDER BY created_at, id, metadata) AS r FROM entities WHERE id < '8') WHERE r = 1),
new AS (SELECT * FROM entities WHERE id >= '8'),
b AS (SELECT name, entity_type, arg_min(id, strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS id, max(strftime(created_at, '%Y%m%d%H%M%S%f') || id) AS last FROM new GROUP BY 1, 2)
SELECT coalesce(o.id, b.id) AS id, coalesce(o.name, b.name) AS name, coalesce(o.entity_type, b.entity_type) AS entity_type, b.last IS NOT NULL AS replaced FROM old o FULL JOIN b ON b.name = o.name AND b.entity_type = o.entity_type""")
def upsert_entities(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "entities")
    first = W.partitionBy("name", "entity_type").orderBy("created_at", "id", "metadata")
    old = e.filter("id < '8'").withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r").withColumn("metadata", F.lit("old"))
    new = e.filter("id >= '8'").withColumn("metadata", F.lit("new"))
    return entities.upsert_entities(old, new).select("id", "name", "entity_type", (F.col("metadata") == "new").alias("replaced"))


@query("SELECT DISTINCT id, name FROM entities WHERE id NOT IN (SELECT record_id FROM deletions WHERE record_kind = 'entity')")
def entities_deleted(s, d):
    ids = table(s, d, "deletions").filter("record_kind = 'entity'").select(F.col("record_id").alias("id"))
    return entities.delete_entities(table(s, d, "entities"), ids).select("id", "name").distinct()


@query("SELECT DISTINCT id, CASE WHEN id IN (SELECT record_id FROM deletions) THEN '{\"gone\":true}' ELSE '{}' END AS metadata FROM entities")
def entity_metadata_updated(s, d):
    e = table(s, d, "entities").withColumn("metadata", F.lit("{}")).distinct()
    changes = table(s, d, "deletions").select(F.col("record_id").alias("id"), F.lit('{"gone":true}').alias("metadata")).distinct()
    return entities.update_entity_metadata(e, changes).select("id", "metadata").distinct()


# --- chunks
@query("SELECT c.id, c.path, c.chunk_index FROM (SELECT DISTINCT id, document_id, path, chunk_index FROM chunks) c JOIN (SELECT DISTINCT id FROM doc_records WHERE rid = (SELECT min(rid) FROM doc_records WHERE id IN (SELECT document_id FROM chunks))) r ON r.id = c.document_id")
def chunks_by_document(s, d):
    r, c = table(s, d, "doc_records"), table(s, d, "chunks").select("id", "document_id", "path", "chunk_index").distinct()
    rid = r.join(c.select(F.col("document_id").alias("id")), "id", "left_semi").agg(F.min("rid")).first()[0]
    return chunks.chunks_by_document(c.withColumn("created_at", F.lit(None)), r.select("id", "rid").distinct(), rid).select("id", "path", "chunk_index")


@query("SELECT c.id, d.rid AS document_rid FROM (SELECT DISTINCT id, document_id FROM chunks) c LEFT JOIN (SELECT id, min(rid) AS rid FROM doc_records GROUP BY id) d ON d.id = c.document_id")
def chunks_with_rid(s, d):
    docs = table(s, d, "doc_records").groupBy("id").agg(F.min("rid").alias("rid"))
    return chunks.with_rid(table(s, d, "chunks").select("id", "document_id").distinct(), docs).select("id", "document_rid")


@query("SELECT DISTINCT id FROM chunks WHERE id NOT IN (SELECT record_id FROM deletions WHERE record_kind = 'chunk')")
def chunks_deleted(s, d):
    ids = table(s, d, "deletions").filter("record_kind = 'chunk'").select(F.col("record_id").alias("id"))
    return chunks.delete_chunks(table(s, d, "chunks"), ids).select("id").distinct()


@query("SELECT DISTINCT id, CASE WHEN id IN (SELECT record_id FROM deletions) THEN 1 ELSE coalesce(len(embedding), -1) END AS n FROM chunks")
def chunk_embeddings_updated(s, d):
    changes = table(s, d, "deletions").select(F.col("record_id").alias("id"), F.array(F.lit(1.0).cast("float")).alias("embedding")).distinct()
    c = chunks.update_chunk_embeddings(table(s, d, "chunks"), changes)
    return c.select("id", F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("n")).distinct()


# --- the same queries over the given tables
for _name in """vec_topk vec_threshold vec_doc_scoped vec_with_context vec_batch_topk edges_from edges_to edges_connected edges_from_entity edges_to_entity mentions
chunks_for_entity bfs_out bfs_both bfs_all_seeds neighbors vector_only contextual multihop hybrid hybrid_scoped entity_centric""".split():
    _over_tables(_name)


# --- what one engine alone decides, by what must hold of it
@query(ORACLES["vec_topk"], views=False)
def vec_ivfflat_all(s, d):
    """The index over clusters, asked in all of them, finds what the exact search finds."""
    return _sims(vector.ClusterIndex(_chunks(s, d), 20).top_k(_vec0(s, d), 5, 0.0, probes=20))


@query("SELECT 0::BIGINT AS n_repeated, 0::BIGINT AS n_out_of_reach, 0::BIGINT AS n_far, 0::BIGINT AS n_gaps")
def dfs_check(s, d):
    """Of the depth-first walk: chunks met twice, not within reach, at another distance than their path's, and gaps in the order."""
    steps = traverse.adjacency(_edges(s, d), time=SEQ)
    found = traverse.dfs(_one(s, "c0"), _chunks(s, d), steps, 3)
    reach = traverse.bfs(_one(s, "c0"), _chunks(s, d), steps, 3).select("id", F.lit(1).alias("reached"))
    far = F.count_if((F.col("distance") != F.size("path") - 1) | (F.col("distance") > 3) | (F.element_at("path", -1) != F.col("id")))
    return found.join(reach, "id", "left").agg(
        (F.count("*") - F.countDistinct("id")).alias("n_repeated"), F.count_if(F.col("reached").isNull()).alias("n_out_of_reach"), far.alias("n_far"), (F.max("ord") + 1 - F.count("*")).alias("n_gaps"),
    )


@query("SELECT 0::BIGINT AS n_long, 0::BIGINT AS n_unnamed, 0::BIGINT AS n_gaps")
def semantic_chunks_check(s, d):
    """Of semantic chunks: those of several sentences above the limit, without the name of the model, and not where the one before ends."""
    from pyspark.sql import Window as W

    t = table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("doc_"), "doc_id").alias("base_path"))
    c = chunkers.semantic_chunks(t, "doc_id", "text", 500, 0.7)
    before = F.lag("end_pos", 1, 0).over(W.partitionBy("doc_id").orderBy("chunk_index"))
    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    # sentences count to the limit, the blanks between them don't
    size = F.octet_length("content") - field("num_sentences").cast("int") + 1
    return c.withColumn("before", before).agg(
        F.count_if((field("num_sentences").cast("int") > 1) & (size > 500)).alias("n_long"), F.count_if(field("embedding_model").isNull()).alias("n_unnamed"), F.count_if(F.col("start_pos") != F.col("before")).alias("n_gaps"),
    )


@query("""WITH t AS (SELECT id, arg_max(content, strftime(updated_at, '%Y%m%d%H%M%S%f') || content) AS text FROM doc_records WHERE content IS NOT NULL AND updated_at IS NOT NULL GROUP BY id),
s AS (SELECT id, len(string_split(replace(replace(replace(text, '! ', '!|'), '? ', '?|'), '. ', '.|'), '|')) AS n FROM t WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT id AS document_id, (n + 2) // 3 AS n_chunks, (n + 2) // 3 AS n_embedded FROM s""")
def ingested_chunks(s, d):
    """The whole pipeline with the sentence chunker and the embedder of tests: chunks of each document, as they would be stored."""
    t = table(s, d, "doc_records").filter("content IS NOT NULL AND updated_at IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("rid", "title", "source", "metadata", "content"), F.struct("updated_at", "content")).alias("r")).select("id", "r.*")
    made = process(t, Pipeline(lambda df: chunkers.sentence_chunks(df, "text", 3).drop("text"), chunkers.length_embedder()))
    return made["chunks"].groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.size("embedding") == 384).alias("n_embedded"))


@query("SELECT regexp_replace(entity_type, '^(B-|I-)', '') AS entity_type, count(*) AS n FROM entities WHERE name IS NOT NULL AND regexp_replace(entity_type, '^(B-|I-)', '') IN ('MISC', 'PER') GROUP BY 1")
def extracted_citations(s, d):
    """Citations made of what an extractor found, with all entities as what was found in one chunk."""
    m = table(s, d, "entities").filter("name IS NOT NULL").select(F.lit("c").alias("chunk_id"), "name", relations.normal_type(F.col("entity_type")).alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    e = relations.link_extracted(relations.extracted_citations(m, s.createDataFrame([("c", "doc.c")], "id string, path string")), s.createDataFrame([("c", "doc.c")], "id string, path string"))
    return e.filter("source_chunk_id = 'c'").select(F.get_json_object("metadata", "$.entity_type").alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))


# --- operators on rows that may be inserted
@query("SELECT document_id, count(*) AS n, count(embedding) AS n_embedded FROM chunks WHERE content IS NOT NULL AND path IS NOT NULL AND document_id IN (SELECT id FROM doc_records) AND (embedding IS NULL OR len(embedding) = 64) GROUP BY 1")
def chunks_inserted(s, d):
    """The chunks that may be inserted, counted by document after insertion into an empty table."""
    c, r = table(s, d, "chunks"), table(s, d, "doc_records").select("id").distinct()
    ok = c.filter("content IS NOT NULL AND path IS NOT NULL AND (embedding IS NULL OR size(embedding) = 64)").join(r.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(c.columns)
    return chunks.insert_chunks(c.limit(0), ok, r, 64).groupBy("document_id").agg(F.count("*").alias("n"), F.count("embedding").alias("n_embedded"))


@query("SELECT DISTINCT c.id, c.path, r.rid AS document_rid FROM chunks c LEFT JOIN (SELECT id, min(rid) AS rid FROM doc_records GROUP BY id) r ON r.id = c.document_id WHERE c.id = (SELECT max(id) FROM chunks)")
def chunk_lookup(s, d):
    c, r = table(s, d, "chunks"), table(s, d, "doc_records").groupBy("id").agg(F.min("rid").alias("rid"))
    return chunks.select_chunk(c, r, c.agg(F.max("id")).first()[0]).select("id", "path", "document_rid").distinct()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT e.source_chunk_id, e.target_chunk_id FROM edges e WHERE e.source_chunk_id <> e.target_chunk_id AND e.source_chunk_id IN (SELECT id FROM chunks) AND e.target_chunk_id IN (SELECT id FROM chunks))")
def neighbors_but_self(s, d):
    c = table(s, d, "chunks").select("id").distinct()
    return traverse.neighbours(c.select(F.col("id").alias("seed"), "id"), c, traverse.adjacency(table(s, d, "edges")), exclude_self=True).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, name FROM entities WHERE entity_type = 'ORG' ORDER BY name, id LIMIT 100")
def entities_by_type_tables(s, d):
    e = table(s, d, "entities").select("id", "name", "entity_type").distinct()
    return entities.select_entities_by_type(e, "ORG").select("id", "name")
