"""Artifacts of many tables: all of them are written first, then one manifest is swapped in.

Readers follow the manifest, so that they see the old run or the new one, whole. A driver
that is lost in between leaves tables that no manifest names; the next write or
``clean`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
SCHEMA = "artifact/v1"
_TABLES = "tables-"


def _jvm_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def table_digest(df: DataFrame) -> dict:
    """Rows of a table and a digest of its content, whatever the order of rows and columns: equal tables, equal digests.

    Three sums over 64-bit hashes of rows, made in parts; it tells runs apart and isn't meant against forgery.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    a, b = F.xxhash64(row), F.xxhash64(F.lit(1), row)
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    n, x, y, z = df.agg(F.count("*"), F.coalesce(F.bit_xor(a), F.lit(0)), wide(a), wide(b)).first()
    return {"rows": n, "digest": "".join(f"{int(v) & (2**64 - 1):016x}" for v in (x, y, z))}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of what was committed last, None before that."""
    at, fs = _jvm_path(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}").collect())
    manifest = json.loads(text)
    if manifest.get("schema") != SCHEMA:
        raise ValueError(f"not a manifest of {SCHEMA}")
    return manifest


def write_artifact(spark: SparkSession, path: str, tables: Mapping[str, tuple[DataFrame, list[str]]], facts: Mapping[str, object] | None = None) -> dict:
    """Write tables (name: rows and the columns that they are sorted by) as one artifact; returns its manifest.

    Tables may read the artifact that they replace. Without sort columns the rows stay in the order of their
    tasks. ``facts`` go into the manifest as they are. Names are letters, digits, ``_`` and ``-``.
    """
    for name in tables:
        if not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"table name {name!r}")
    stage, entries = f"{_TABLES}{uuid.uuid4().hex}", {}
    for name, (df, keys) in tables.items():
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        placed.write.parquet(f"{path}/{stage}/{name}", compression="zstd")
        written = spark.read.schema(df.schema).parquet(f"{path}/{stage}/{name}")
        entries[name] = {"path": f"{stage}/{name}", "schema": df.schema.jsonValue(), **table_digest(written)}
    manifest = {"schema": SCHEMA, "facts": dict(facts or {}), "tables": entries}
    _swap(spark, path, json.dumps(manifest, sort_keys=True))
    clean(spark, path)
    return manifest


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """Put the manifest in place by one rename."""
    new, fs = _jvm_path(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, _jvm_path(spark, f"{path}/{MANIFEST}")[0], options)


def read_artifact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of what was committed last."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no artifact in {path}")
    return {name: spark.read.schema(StructType.fromJson(e["schema"])).parquet(f"{path}/{e['path']}") for name, e in manifest["tables"].items()}


def changed_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of tables whose content isn't what the manifest says."""
    manifest, tables = read_manifest(spark, path), read_artifact(spark, path)
    return sorted(name for name, df in tables.items() if table_digest(df) != {k: manifest["tables"][name][k] for k in ("rows", "digest")})


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete what no manifest names: tables of replaced and unfinished runs. Not while another run writes or reads older tables there."""
    root, fs = _jvm_path(spark, path)
    manifest = read_manifest(spark, path) or {"tables": {}}
    kept = {e["path"].split("/")[0] for e in manifest["tables"].values()}
    gone = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith((_TABLES, f"{MANIFEST}.")) and name not in kept:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
