"""Views of a small document graph over the embeddings and TPC-H tables, as SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomgraph.runtime import table

SQL = {
    "fx_chunks": """
SELECT concat('c', CAST(vec_id AS STRING)) AS id, CAST(label AS BIGINT) AS document_id,
 concat('doc', CAST(label AS STRING)) AS document_rid,
 concat('root.s', CAST(label AS STRING), '.p', CAST(vec_id AS STRING)) AS path,
 embedding, CAST(vec_id AS INT) AS chunk_index FROM embeddings
 UNION ALL SELECT concat('s', CAST(label AS STRING)), CAST(label AS BIGINT), concat('doc', CAST(label AS STRING)),
 concat('root.s', CAST(label AS STRING)), NULL, NULL FROM (SELECT DISTINCT label FROM embeddings)
 UNION ALL SELECT 'root', CAST(0 AS BIGINT), 'doc0', 'root', NULL, NULL""",
    "fx_edges": """
SELECT concat('r', CAST(vec_id AS STRING)) AS id, concat('c', CAST(vec_id AS STRING)) AS source_chunk_id,
  concat('c', CAST((vec_id*7+1) % n.n AS STRING)) AS target_chunk_id, CAST(NULL AS STRING) AS source_entity_id, CAST(NULL AS STRING) AS target_entity_id,
  'reference' AS edge_type, CAST(vec_id % 10 AS DOUBLE)/10 AS weight, false AS bidirectional, CAST(vec_id AS BIGINT) AS created_seq FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
 UNION ALL SELECT concat('m', CAST(vec_id AS STRING)), concat('c', CAST(vec_id AS STRING)), concat('c', CAST((vec_id*13+5) % n.n AS STRING)), NULL, NULL,
  'semantic', CAST(vec_id % 4 AS DOUBLE)/4, vec_id % 3 = 0, CAST(vec_id + n.n AS BIGINT) FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
 UNION ALL SELECT concat('e', CAST(vec_id AS STRING)), concat('c', CAST(vec_id AS STRING)), NULL, NULL, concat('n', CAST(vec_id % 25 AS STRING)),
  'entity_mention', CAST(1 AS DOUBLE), false, CAST(vec_id + 2*n.n AS BIGINT) FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
 UNION ALL SELECT concat('f', CAST(vec_id AS STRING)), NULL, concat('c', CAST(vec_id AS STRING)), concat('n', CAST(vec_id % 7 AS STRING)), NULL,
  'custom', CAST(1 AS DOUBLE), false, CAST(vec_id + 3*n.n AS BIGINT) FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) n WHERE vec_id % 50 = 0
 UNION ALL SELECT concat('x', CAST(vec_id AS STRING)), concat('c', CAST(vec_id AS STRING)), concat('gone', CAST(vec_id AS STRING)), NULL, NULL,
  'reference', CAST(1 AS DOUBLE), false, CAST(vec_id + 4*n.n AS BIGINT) FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) n WHERE vec_id % 40 = 0""",
    "fx_entities": """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, n_name AS name, 'NATION' AS entity_type FROM nation
 UNION ALL SELECT concat('g', CAST(r_regionkey AS STRING)), r_name, 'REGION' FROM region""",
}
# views of the given tables, which only the SQL side reads: the plans read the tables themselves
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL["tb_chunks"] = f"""
SELECT c.*, r.document_rid FROM (SELECT id, min(document_id) AS document_id, min(path) AS path, min(chunk_index) AS chunk_index,
  any_value(CASE WHEN {_USABLE} THEN embedding END) AS embedding FROM chunks WHERE id IS NOT NULL GROUP BY id) c
  LEFT JOIN (SELECT id, min(rid) AS document_rid FROM doc_records GROUP BY id) r ON r.id = c.document_id"""
SQL["tb_edges"] = "SELECT *, created_at AS created_seq FROM edges"
_TABLES = ("embeddings", "nation", "region")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = SQL[name]
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", sql)]
    return spark.sql(re.sub(rf"\bFROM ({'|'.join(_TABLES)})\b", r"FROM {\1}", sql), **{t: table(spark, d, t) for t in used})


def with_views(sql: str, recursive: bool = False) -> str:
    """An SQL text with the views that it names put before it."""
    ctes = [f"{n} AS ({s})" for n, s in SQL.items() if re.search(rf"\b{n}\b", sql)]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}{',' if sql.lstrip().startswith(',,') else ''} {sql.lstrip().removeprefix(',,')}"
