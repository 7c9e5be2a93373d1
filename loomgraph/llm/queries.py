"""Queries of the operators for training data, with SQL where SQL can say the same over whole tables."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import knn, leakage, names, neardup, packing, pii, splitting
from loomgraph.operators.components import components
from loomgraph.runtime import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_pairs(names.same_entities(table(spark, d, "entities")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, group): each id of entities with the smallest id of those that name the same thing."""
    groups = names.same_entities(table(spark, d, "entities"))
    low = groups.groupBy("kind", "group").agg(F.min("id").alias("low"))
    return groups.join(low, ["kind", "group"]).groupBy("id").agg(F.min("low").alias("group"))


def _chunk_duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, d, "chunks"), "id", "content", words=3, least=0.7, least_words=20)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_duplicates(spark, d).id_pairs()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, group): the chunks that have a near-duplicate, with the smallest id of those they are connected with."""
    return components(_chunk_duplicates(spark, d).id_pairs())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest(table(spark, d, "chunks"), "id", "embedding"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that had to be split."""
    return splitting.split_oversized(table(spark, d, "doc_records")).select("id").distinct()


def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "doc_records"))


#: Folder of the vocabulary files of public tokenizers, the same on all executors.
TOKENIZERS = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The text of each test item that may leak: its passage, of suite closed_book its question."""
    return table(spark, d, "eval_items").select("item_id", F.when(F.col("suite") == "closed_book", F.col("question")).otherwise(F.col("passage")).alias("passage"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), _items(spark, d))


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Longest verbatim match and its place for each document and item that leaks."""
    return leakage.verbatim_matches(table(spark, d, "documents"), _items(spark, d)).filter("leaks").select("doc_id", "item_id", "longest", "at_word")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no test item."""
    return leakage.without_leaks(table(spark, d, "documents"), _items(spark, d)).select("doc_id")


def _key(spark: SparkSession) -> bytes:
    """The secret of the surrogates: the setting ``spark.loomgraph.pii.key``, else a new one for each call."""
    return spark.conf.get("spark.loomgraph.pii.key", "").encode() or secrets.token_bytes(32)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.detected(table(spark, d, "documents"), _key(spark)).select("doc_id", "pii_type", "value")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return pii.surrogated(table(spark, d, "documents"), _key(spark))


def p9_surrogate_faults(spark: SparkSession, d: str) -> DataFrame:
    """Surrogates that stand for two values or for themselves, over all texts: none."""
    return pii.surrogate_faults(pii.detected(table(spark, d, "documents"), _key(spark)))


def p9_redaction_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents as many as before, and of those redacted or with surrogates, how many still hold a plain e-mail address."""
    docs = table(spark, d, "documents")
    kept = lambda t: F.count_if(F.col(t).rlike(_EMAIL))
    r = pii.redacted(docs).agg(F.count("*").alias("n_documents"), kept("text").alias("n_left"))
    return r.select("n_documents", "n_left")


_EMAIL = r"[a-z0-9]+@[a-z0-9-]+\.(?:com|org|net|example)\b"


# --- what must hold of results that SQL can't give over whole tables
def p2_groups_check(spark: SparkSession, d: str) -> DataFrame:
    """Ids that have a group, and those whose group isn't named by a smaller or the same id, or has another group."""
    g = p2_groups(spark, d)
    named = g.select(F.col("id").alias("group"), F.col("group").alias("again"))
    bad = (F.col("group") > F.col("id")) | F.col("again").isNull() | (F.col("again") != F.col("group"))
    return g.join(named, "group", "left").agg(F.count("*").alias("n_ids"), F.count_if(bad).alias("n_bad"))


def p5_chunks_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were split; pieces above the limit, or repeating too much; documents that their pieces don't make up."""
    records = table(spark, d, "doc_records")
    before = F.lag("end_pos", 1, 0).over(W.partitionBy("id").orderBy("chunk_index"))
    p = splitting.split_oversized(records).withColumn("again", before - F.col("start_pos"))
    p = p.withColumn("own", F.expr("substring(content, again + 1)")).withColumn("repeated", F.expr("octet_length(content) - octet_length(own)"))
    made = p.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "own"))), lambda x: x["own"]), "").alias("whole"),
        F.count_if((F.octet_length("content") > splitting.MOST) | (F.col("again") < 0)).alias("over"), F.count_if(F.col("repeated") > splitting.OVERLAP).alias("wide"),
    )
    return made.join(splitting.newest(records).select("id", "content"), "id").agg(
        F.count("*").alias("n_documents"), F.sum("over").alias("n_over"), F.sum("wide").alias("n_wide"), F.count_if(F.col("whole") != F.col("content")).alias("n_changed"),
    )


def p7_containers_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were placed; containers above the capacity; documents split though they fit, or not placed whole."""
    placed = cut(p7_containers(spark, d))
    over = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("n_over"))
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("begin_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"))
    whole = per.agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("n_split"), F.count_if(F.col("n") != F.col("end")).alias("n_parts"))
    one = F.lit(1).alias("one")
    return whole.select("*", one).join(over.select("*", one), "one").drop("one")


def p8_partition(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a test item and documents that hold none: together all, and none is both."""
    clean, leaking = p8_clean(spark, d).select("doc_id", F.lit(1).alias("c")), p8_found(spark, d).select("doc_id", F.lit(1).alias("l")).distinct()
    return clean.join(leaking, "doc_id", "full_outer").agg(F.count("*").alias("n_documents"), F.count_if(F.col("c").isNotNull() & F.col("l").isNotNull()).alias("n_both"))


QUERIES = {"p2_groups_check": p2_groups_check, "p5_chunks_check": p5_chunks_check, "p7_containers_check": p7_containers_check, "p8_partition": p8_partition, "p5_found": p5_found, "p5_chunks": p5_chunks, "p7_containers": p7_containers, "p7_fill": p7_fill, "p2_found": p2_found, "p2_groups": p2_groups, "p9_found": p9_found, "p9_redacted": p9_redacted, "p9_surrogates": p9_surrogates, "p9_surrogate_faults": p9_surrogate_faults, "p9_redaction_check": p9_redaction_check, "p3_found": p3_found, "p3_groups": p3_groups, "p8_found": p8_found, "p8_matches": p8_matches, "p8_clean": p8_clean, "p4_found": p4_found}

ORACLES: dict[str, str] = {
    "p9_surrogate_faults": "SELECT 'NAME' AS pii_type, '' AS surrogate, 2::BIGINT AS n_values, false AS kept WHERE false",
    "p9_redaction_check": "SELECT count(*) AS n_documents, 0::BIGINT AS n_left FROM documents",
    "p3_found": """
WITH t AS (SELECT id, regexp_extract_all(lower(min(content)), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT DISTINCT id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT id, w FROM t WHERE len(w) >= 20), unnest(range(1, len(w) - 1)) u(k)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT id_a, id_b FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE c >= 0.7 * (p.n + q.n - c) - 1e-9""",
    "p4_found": """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
r AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 5""",
    "p5_found": """
SELECT id FROM (SELECT id, content, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, content DESC NULLS LAST) AS r FROM doc_records WHERE id IS NOT NULL)
WHERE r = 1 AND strlen(content) > 4000""",
}
_LARGE = ORACLES["p5_found"]
ORACLES |= {
    # the components of the pairs of p3_found
    "p3_groups": f"""
WITH RECURSIVE p AS ({ORACLES["p3_found"]}),
e AS (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p),
r AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o)
SELECT id, min(o) AS "group" FROM r GROUP BY 1""",
    "p2_groups_check": "SELECT count(DISTINCT id) AS n_ids, 0::BIGINT AS n_bad FROM entities WHERE id IS NOT NULL AND regexp_matches(name, '[\\p{L}\\p{N}]')",
    "p5_chunks_check": f"SELECT count(*) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_wide, 0::BIGINT AS n_changed FROM ({_LARGE})",
    "p7_containers_check": "SELECT count(*) AS n_documents, 0::BIGINT AS n_split, 0::BIGINT AS n_parts, 0::BIGINT AS n_over FROM documents WHERE text IS NOT NULL",
    "p8_partition": "SELECT count(*) AS n_documents, 0::BIGINT AS n_both FROM documents",
}
