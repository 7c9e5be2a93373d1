"""Session-level helpers: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the context a checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without
    that setting (tests) gets a temporary folder; a cluster session without it is refused.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to, as of what led to a ``cut``.

    It does so when the driver's garbage is collected, which may not happen before a query ends.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Number of reduce tasks to plan for: the session's shuffle partitions, one at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` hinted for broadcast after its row count was checked, else as it is, to be joined by shuffling."""
    return F.broadcast(df) if small(df, most_rows) else df
