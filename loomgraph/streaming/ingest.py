"""Ingestion of a stream of documents: an extension, as documents may also arrive as files over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from loomgraph.facade import GraphStore
from loomgraph.plans.ingest import Pipeline


def read_documents(spark: SparkSession, folder: str, schema: str = "id long, rid string, title string, source string, metadata string, content string") -> DataFrame:
    """Documents from Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest_stream(documents: DataFrame, root: str, pipeline: Pipeline, checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """A writer that ingests each micro-batch and publishes a version, each batch once.

    The manifest keeps the last batch of each stream under ``name`` (by default its checkpoint folder), apart from the
    version, so that a store may have been written before and by others. Documents without content are left out, as an
    error would stop the stream at them for good.
    """
    stream = name or checkpoint

    def batch(df: DataFrame, number: int) -> None:
        store = GraphStore(df.sparkSession, root)
        if store.manifest["batches"].get(stream, -1) >= number:
            return
        store.set_pipeline(pipeline)
        store.process_and_insert(df, on_empty="skip")
        store.save(batch=(stream, number))

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
