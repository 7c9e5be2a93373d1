"""Documents: insert, look up, list, search, update, delete, read from files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import contains_ilike
from loomgraph.runtime import cut


def insert_documents(documents: DataFrame, new: DataFrame, now: Column | None = None, rid: Column | None = None) -> DataFrame:
    """``documents`` with the rows of ``new`` (title, source, metadata), given ids, rids and times.

    Ids continue after the largest. They are numbered by a global sort of the new rows, in ranges: counts of the sorted
    partitions give each range its offset, so that no task sees all rows. ``rid`` and ``now`` may be injected; the
    default rid is random, so write the result before reading it twice.
    """
    now = F.current_timestamp() if now is None else now
    bad = new.filter("title IS NULL").limit(1).count()
    if bad:
        raise ValueError("title must not be null")
    top = documents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # written out, so that both uses below see the same partitions
    ordered = cut(new.select("title", "source", "metadata").sort("title", "source", "metadata").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_before", "_first")
    rows = ordered.join(F.broadcast(offsets), "_p").withColumn("id", F.lit(top) + 1 + F.col("_before") + F.col("_k") - F.col("_first"))
    rows = rows.select("id", (F.uuid() if rid is None else rid).alias("rid"), "title", "source", "metadata", now.alias("created_at"), now.alias("updated_at"))
    return documents.select(rows.columns).unionByName(rows)


def select_document(documents: DataFrame, rid: str) -> DataFrame:
    return documents.filter(F.col("rid") == rid)


def select_all_documents(documents: DataFrame, last_created_at: datetime | str | None = None, limit: int = 100) -> DataFrame:
    """The newest documents before ``last_created_at``; ties by id. Rows that share the last time of a page are skipped by the next."""
    page = documents if last_created_at is None else documents.filter(F.col("created_at") < F.lit(last_created_at).cast("timestamp"))
    return page.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def search_documents(documents: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """Documents whose title or source holds ``term``, without regard to case, newest first."""
    hit = contains_ilike(F.col("title"), term) | contains_ilike(F.col("source"), term)
    return documents.filter(hit).orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def update_documents(documents: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Title, source and metadata of the rids in ``changes`` replaced, updated_at set. Rids that aren't there do nothing."""
    now = F.current_timestamp() if now is None else now
    c = changes.select("rid", *[F.col(x).alias(f"_{x}") for x in ("title", "source", "metadata")], F.lit(True).alias("_hit"))
    j = documents.join(c, "rid", "left")
    take = lambda x: F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x)
    return j.select(*[take(x) if x in ("title", "source", "metadata") else F.when(F.col("_hit"), now).otherwise(F.col(x)).alias(x) if x == "updated_at" else x for x in documents.columns])


def delete_documents(documents: DataFrame, chunks: DataFrame, rids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the documents of ``rids`` and their chunks. Edges are left dangling."""
    gone = documents.join(rids.select("rid"), "rid", "left_semi").select("id")
    left = documents.join(rids.select("rid"), "rid", "left_anti").select(documents.columns)
    return left, chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(chunks.columns)


def title_of(path: Column) -> Column:
    """The base name of a path without its last extension; the whole name if nothing else is left."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    short = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.when(short == "", base).otherwise(short)


def documents_from_files(spark: SparkSession, path: str, metadata: str = "{}") -> DataFrame:
    """(title, source, metadata, content): each text file under ``path`` as a document."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"))
    return files.select(title_of(F.col("source")).alias("title"), "source", F.lit(metadata).alias("metadata"), "content")
