"""Shared helpers: reading tables, tables in the cluster's shared folder, joins with hot keys, bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.store import discard, materialize, shared_dir

__all__ = ["HOT_SHARE", "discard", "join_hot", "materialize", "pieces", "release", "shared_dir", "slices", "table", "unused"]


#: Keys with over 1 / HOT_SHARE of all rows count as hot.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, *, n_col: str = "n", rows_total: int | None = None, how: str = "inner", small: Column | None = None) -> DataFrame:
    """Join rows to a table with one row a key, whose ``n_col`` says how many of the rows have that key.

    Keys of more than one row in ``HOT_SHARE`` are at most ``HOT_SHARE`` keys,
    whatever the data: these few are broadcast, so that a hot key's rows stay
    where they are. All other keys meet by a shuffle. Both tables are read
    twice and should be materialised. ``how`` is inner or left. Where the rows of
    the second table have no bounded size, ``small`` says which of them may be
    broadcast.
    """
    total = rows.count() if rows_total is None else rows_total
    hot = F.col(n_col) * HOT_SHARE > total
    hot = hot if small is None else F.coalesce(hot & small, F.lit(False))
    few = per_key.where(hot).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(few), key, "left")
    kept = [c for c in marked.columns if c != "__hot"]
    found = marked.where("__hot").select(kept)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(per_key.where(~hot), key, how)
    return found.unionByName(others.select(kept))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores after those that a table has in any case of letters, and all different."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(arrays, max_bytes: int):
    """Arrow arrays of strings or bytes in parts of about ``max_bytes``, or of one value."""
    try:
        for array in arrays:
            for part in slices([pa.RecordBatch.from_arrays([array], ["x"])], "x", max_bytes):
                yield part.column("x")
    finally:
        release()


def release() -> None:
    """Give freed memory back: Spark keeps a Python worker after its task, and an executor's limit counts what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, column: str, max_bytes: int = 8 << 20):
    """Arrow batches cut so that a slice holds about ``max_bytes`` of a text column, or one row."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.cumsum(lengths) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
