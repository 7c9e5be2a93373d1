"""Queries of the general corpus operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import normal_id
from loomgraph.operators.orphans import orphans
from loomgraph.operators.skew import fragment_replicate_join, pair_counts
from loomgraph.runtime import table

PAIR = ["source_entity_id", "edge_type"]


def p1_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = pair_counts(table(spark, d, "edges"), PAIR, "id", ["target_chunk_id", "target_entity_id"], "weight")
    return counts.withColumn("mean_weight", F.round("mean_weight", 9))


def p1_named_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each kind by the name of their source entity: the join of skewed edges with entities."""
    edges = table(spark, d, "edges").select(normal_id(F.col("source_entity_id")).alias("k"), F.col("edge_type"))
    names = table(spark, d, "entities").select(normal_id(F.col("id")).alias("k"), "name").distinct()
    joined = fragment_replicate_join(edges, names, ["k"])
    return joined.groupBy("name", "edge_type").agg(F.count("*").alias("n_edges"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "ref_column").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per endpoint column and month; an edge without created_at is in month 'none'."""
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none")).alias("month")
    once = _orphans(spark, d).distinct()
    return once.groupBy("ref_column", month).agg(F.count("*").alias("n_references"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans(*[table(spark, d, t) for t in ("edges", "chunks", "entities", "deletions")])


_NORM = "nullif(lower(regexp_replace({}, '^[\\s{{}}]+|[\\s{{}}]+$', '', 'g')), '')"
_ORPHANS = f"""
WITH refs AS (
  SELECT id AS edge_id, created_at, ref_column, kind, {_NORM.format('v')} AS k FROM (
    SELECT id, created_at, 'source_chunk_id' AS ref_column, 'chunk' AS kind, source_chunk_id AS v FROM edges
    UNION ALL SELECT id, created_at, 'target_chunk_id', 'chunk', target_chunk_id FROM edges
    UNION ALL SELECT id, created_at, 'source_entity_id', 'entity', source_entity_id FROM edges
    UNION ALL SELECT id, created_at, 'target_entity_id', 'entity', target_entity_id FROM edges)),
there AS (
  SELECT kind, k, min(created_at) AS first_at, max(created_at) AS last_at FROM (
    SELECT 'chunk' AS kind, {_NORM.format('id')} AS k, created_at FROM chunks
    UNION ALL SELECT 'entity', {_NORM.format('id')}, created_at FROM entities) GROUP BY 1, 2),
gone AS (SELECT record_kind AS kind, {_NORM.format('record_id')} AS k, max(deleted_at) AS deleted_at FROM deletions GROUP BY 1, 2),
bad AS (
  SELECT DISTINCT r.edge_id, r.ref_column, r.created_at FROM refs r
  LEFT JOIN there t ON t.kind = r.kind AND t.k = r.k LEFT JOIN gone g ON g.kind = r.kind AND g.k = r.k
  WHERE r.k IS NOT NULL AND (t.k IS NULL OR g.deleted_at > t.last_at OR t.first_at > r.created_at))
"""

QUERIES = {"p1_pair_counts": p1_pair_counts, "p1_named_counts": p1_named_counts, "p6_found": p6_found, "p6_report": p6_report}

ORACLES = {
    "p1_pair_counts": """
SELECT e.source_entity_id, e.edge_type, count(*) AS n_rows, count(DISTINCT e.id) AS n_ids,
  count(DISTINCT e.target_chunk_id) + count(DISTINCT e.target_entity_id) AS n_targets, round(avg(e.weight), 9) AS mean_weight
FROM edges e GROUP BY 1, 2""",
    "p1_named_counts": f"""
WITH n AS (SELECT DISTINCT {_NORM.format('id')} AS k, name FROM entities)
SELECT n.name, e.edge_type, count(*) AS n_edges FROM edges e JOIN n ON n.k = {_NORM.format('e.source_entity_id')} GROUP BY 1, 2""",
    "p6_found": _ORPHANS + "SELECT DISTINCT edge_id, ref_column FROM bad",
    "p6_report": _ORPHANS + """
SELECT ref_column, coalesce(strftime(created_at AT TIME ZONE 'UTC', '%Y-%m'), 'none') AS month, count(*) AS n_references FROM bad GROUP BY 1, 2""",
}
