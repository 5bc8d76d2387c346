"""Tables of a run's own in the folder that the cluster shares: what is read more than once is written once."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Without either, a local session (one machine, as in tests) gets a temporary
    folder; on a cluster that is an error, as each executor would write to its own disk.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike a cache it survives lost executors, and the files give Catalyst true
    sizes, so that it broadcasts the table only if it is small. ``by`` is a column
    by whose values the table is read in parts: each has files of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression, partitionBy=by)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: what was made of them must be written already."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then executors delete the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
