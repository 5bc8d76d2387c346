"""Artifacts: whole or not at all, and the same for the same tables."""

import os

import pytest
from pyspark.sql import functions as F

from spanforge.sources import artifact
from spanforge.sources.artifact import changed_tables, clean, read_artifact, read_manifest, table_digest, write_artifact


def test_written_and_replaced(spark, tmp_path):
    at = str(tmp_path / "run")
    one = spark.createDataFrame([(2, "b", None), (1, "a", [1])], "k int, v string, x array<int>")
    assert read_manifest(spark, at) is None and clean(spark, at) == []
    first = write_artifact(spark, at, {"one": (one, ["k"]), "none": (one.limit(0), [])}, {"hash": "h"})
    assert {n: (e["rows"]) for n, e in first["tables"].items()} == {"one": 2, "none": 0} and first["facts"] == {"hash": "h"}
    tables = read_artifact(spark, at)
    assert [tuple(r) for r in tables["one"].orderBy("k").collect()] == [(1, "a", [1]), (2, "b", None)] and tables["none"].schema == one.schema and changed_tables(spark, at) == []
    # The same rows in another order, over the artifact itself: the same digests, one set of tables.
    again = write_artifact(spark, at, {"one": (tables["one"].orderBy(F.desc("k")).repartition(3), ["k"]), "none": (tables["none"], [])}, {"hash": "h"})
    digests = lambda m: {n: (e["rows"], e["digest"]) for n, e in m["tables"].items()}
    assert digests(again) == digests(first) and len([x for x in os.listdir(at) if x.startswith("tables-")]) == 1
    assert table_digest(one.union(one.limit(1)))["digest"] != table_digest(one)["digest"] != table_digest(one.withColumn("v", F.lit("a")))["digest"]
    with pytest.raises(ValueError):
        write_artifact(spark, at, {"../x": (one, [])})


def test_a_writer_that_is_lost_leaves_the_old_run(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "run")
    old, new = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    write_artifact(spark, at, {"a": (old, ["k"]), "b": (old, ["k"])})
    whole = table_digest

    def lost(df):
        if df.where("k = 3").count() and "/b" in df.inputFiles()[0]:
            raise KeyboardInterrupt
        return whole(df)

    monkeypatch.setattr(artifact, "table_digest", lost)
    with pytest.raises(KeyboardInterrupt):
        write_artifact(spark, at, {"a": (new, ["k"]), "b": (new, ["k"])})
    monkeypatch.setattr(artifact, "table_digest", whole)
    assert {n: df.count() for n, df in read_artifact(spark, at).items()} == {"a": 1, "b": 1} and changed_tables(spark, at) == []
    assert len(clean(spark, at)) == 1 and {n: df.count() for n, df in read_artifact(spark, at).items()} == {"a": 1, "b": 1}
    write_artifact(spark, at, {"a": (new, ["k"]), "b": (new, ["k"])})
    assert {n: df.count() for n, df in read_artifact(spark, at).items()} == {"a": 2, "b": 2}


def test_tampered_tables_are_named(spark, tmp_path):
    at = str(tmp_path / "run")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    manifest = write_artifact(spark, at, {"a": (df, ["k"]), "b": (df, ["k"])})
    df.limit(1).write.mode("overwrite").parquet(f"{at}/{manifest['tables']['b']['path']}")
    assert changed_tables(spark, at) == ["b"]
