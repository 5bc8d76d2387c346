"""Corpus and observation documents as tables, and their validation.

A corpus document is one JSON object with ``cases``; an observation document
holds each scanner's result. Validation returns violations as rows; ``refuse``
raises if there are any.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import canonical
from spanforge.functions.text import valid_range
from spanforge.operators.generation import SPAN, envelopes_meet_spans
from spanforge.operators.measure import MAX_LABELS

RANGE = "struct<start:bigint,end:bigint>"
CASE = (
    "struct<id:string,path:string,content:string,"
    "expected:array<struct<start:bigint,end:bigint,role:string,envelope:struct<start:bigint,end:bigint,reason:string>>>,"
    "grouping:struct<kind:string,tier:string,family:string,group:string,evidence_class:string,targets:array<string>,taxonomy:string>,"
    "twin:struct<twin_of:string,mutation:string,mutation_kind:string,sibling_family:string>>"
)
CORPUS = f"schema string, identity struct<source:string,revision:string,evidence_schema:string,corpus_digest:string>, cases array<{CASE}>"
FINDING = "struct<path:string,start:bigint,end:bigint,family:string,action:string,native_labels:array<string>>"
OBSERVATIONS = (
    "schema string, corpus_digest string, observations array<struct<scanner:struct<id:string,version:string,mode:string,configuration_hash:string>,"
    f"result:struct<status:string,findings:array<{FINDING}>,replays:struct<count:int,agreed:boolean>,unmeasured:array<struct<path:string,reason:string>>,reason:string>>>"
)
KINDS, TIERS = ("must-redact", "must-not-flag", "policy"), ("T0", "T1", "T2", "T3")
STATUSES = ("complete", "unstable", "unsupported", "unavailable", "timeout", "malformed", "error")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a case: case_id, path, content, expected, kind, tier, family, group, targets, twin_of, sibling, taxonomy, mutation, mutation_kind. A document that doesn't parse fails."""
    documents = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    c = documents.select(F.explode("cases").alias("c"), F.col("identity.corpus_digest").alias("corpus_digest"))
    return c.select(
        F.col("c.id").alias("case_id"), "c.path", "c.content", "c.expected", "c.grouping.kind", "c.grouping.tier", "c.grouping.family", "c.grouping.group", "c.grouping.targets",
        F.col("c.twin.twin_of").alias("twin_of"), F.col("c.twin.sibling_family").alias("sibling"), "corpus_digest",
        "c.grouping.taxonomy", "c.twin.mutation", "c.twin.mutation_kind",
    )


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(declared, corpus_digest, input_digest) of each corpus document, computed from its own JSON, unknown fields included.

    corpus_digest covers the cases sorted by id, input_digest the paths and the
    digests of the contents alone, sorted by path. A document is read whole, by
    one task, as by its reader.
    """

    @F.arrow_udf("struct<declared:string,corpus_digest:string,input_digest:string>")
    def digests(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            document = json.loads(t)
            cases = document.get("cases") or []
            out.append({"declared": (document.get("identity") or {}).get("corpus_digest"), "corpus_digest": canonical.corpus_digest(cases), "input_digest": canonical.input_digest(cases)})
        return pa.array(out, pa.struct([("declared", pa.string()), ("corpus_digest", pa.string()), ("input_digest", pa.string())]))

    return spark.read.text(path, wholetext=True).select(digests(F.col("value")).alias("d")).select("d.*")


def seal(source: str, revision: str, evidence_schema: str, cases: list[dict]) -> dict:
    """A corpus document of these cases that declares its digest."""
    identity = {"source": source, "revision": revision, "evidence_schema": evidence_schema, "corpus_digest": canonical.corpus_digest(cases)}
    return {"schema": "corpus-snapshot", "identity": identity, "cases": cases}


def digest_violations(spark: SparkSession, path: str) -> DataFrame:
    """(declared, corpus_digest) of documents whose cases aren't those that the declared digest stands for."""
    return document_digests(spark, path).where("not (declared <=> corpus_digest)").select("declared", "corpus_digest")


def spans_of(cases: DataFrame) -> DataFrame:
    """One row a span, in the order in which the case lists them."""
    s = cases.select("case_id", F.posexplode("expected").alias("span_idx", "s"))
    return s.select(
        "case_id", "span_idx", "s.role", F.col("s.start").alias("start_byte"), F.col("s.end").alias("end_byte"), F.col("s.envelope.start").alias("env_start"), F.col("s.envelope.end").alias("env_end"), F.col("s.envelope.reason").alias("env_reason")
    )


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanners, findings, unmeasured), by path; findings keep the order of the document as emit_seq."""
    o = spark.read.schema(OBSERVATIONS).option("multiLine", True).option("mode", "FAILFAST").json(path).select("corpus_digest", F.explode("observations").alias("o"))
    scanners = o.select(F.col("o.scanner.id").alias("scanner"), F.col("o.result.status").alias("status"), "corpus_digest")
    f = o.select(F.col("o.scanner.id").alias("scanner"), F.posexplode("o.result.findings").alias("emit_seq", "f"))
    findings = f.select("scanner", "f.path", F.col("f.start").alias("start_byte"), F.col("f.end").alias("end_byte"), "f.family", "f.action", F.coalesce("f.native_labels", F.array().cast("array<string>")).alias("labels"), "emit_seq")
    u = o.select(F.col("o.scanner.id").alias("scanner"), F.explode("o.result.unmeasured").alias("u"))
    return scanners, findings, u.select("scanner", "u.path", "u.reason")


def on_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows by path -> rows by case."""
    return rows.join(cases.select("path", "case_id"), "path").drop("path")


def corpus_violations(cases: DataFrame) -> DataFrame:
    """(case_id, reason) for everything that makes a corpus unusable."""
    spans = spans_of(cases)
    by_start = Window.partitionBy("case_id").orderBy("span_idx")
    checked = spans.join(cases.select("case_id", "content"), "case_id").withColumn("last_end", F.lag("end_byte").over(by_start))
    twins = cases.where("twin_of is not null").select("case_id", "twin_of", F.col("kind").alias("t_kind"))
    originals = cases.select(F.col("case_id").alias("o_id"), F.exists(F.coalesce("expected", F.array().cast(f"array<{SPAN}>")), lambda s: s["role"] == "secret").alias("o_secret"))
    paired = twins.join(originals, twins.twin_of == originals.o_id, "left")
    secret = F.exists("expected", lambda s: s["role"] == "secret")

    def bad(df: DataFrame, when, reason: str) -> DataFrame:
        return df.where(when).select("case_id", F.lit(reason).alias("reason"))

    found = [
        cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate id").alias("reason")),
        cases.groupBy("path").agg(F.min("case_id").alias("case_id"), F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate path").alias("reason")),
        bad(cases, ~F.col("kind").isin(*KINDS) | ~F.col("tier").isin(*TIERS) | F.col("kind").isNull() | F.col("tier").isNull(), "unknown kind or tier"),
        bad(cases, (F.col("kind") == "must-not-flag") & F.coalesce(secret, F.lit(False)), "control with a secret"),
        bad(cases, (F.col("kind") != "must-not-flag") & (F.col("tier") != "T0") & ~F.coalesce(secret, F.lit(False)), "positive without a secret"),
        bad(checked, ~valid_range(F.col("content"), F.col("start_byte"), F.col("end_byte")), "invalid range"),
        bad(checked, F.col("start_byte") < F.col("last_end"), "spans out of order or overlapping"),
        bad(checked, F.col("env_start").isNotNull() & ((F.col("env_start") > F.col("start_byte")) | (F.col("env_end") < F.col("end_byte")) | F.col("env_reason").isNull()), "envelope without reason or not around its span"),
        bad(cases, envelopes_meet_spans(F.coalesce("expected", F.array().cast(f"array<{SPAN}>"))), "envelope over another span"),
        bad(cases, F.col("twin_of").isNotNull() & F.coalesce(secret, F.lit(False)), "twin with a secret"),
        bad(cases, F.col("twin_of").isNotNull() & (F.trim(F.coalesce("mutation", F.lit(""))) == ""), "twin without mutation"),
        bad(cases, F.col("sibling").isNotNull() & ((F.trim("sibling") == "") | (F.trim("sibling") != F.col("sibling")) | F.col("family").isNull() | (F.col("sibling") == F.col("family"))), "sibling blank, padded, without a family or the family itself"),
        bad(paired, F.col("o_id").isNull(), "twin of an unknown case"),
        bad(paired, F.col("twin_of") == F.col("case_id"), "twin of itself"),
        bad(paired, F.col("t_kind") != "must-not-flag", "twin is no control"),
        bad(paired, F.col("o_id").isNotNull() & ~F.col("o_secret"), "twin of a case without a secret"),
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def observation_violations(findings: DataFrame, unmeasured: DataFrame, cases: DataFrame) -> DataFrame:
    """(scanner, path, reason) for findings and unmeasured paths that don't fit the corpus."""
    joined = findings.join(cases.select("path", "content", F.lit(True).alias("known")), "path", "left")
    dropped = findings.join(unmeasured.select("scanner", "path").distinct(), ["scanner", "path"], "left_semi")
    labels = F.col("labels")
    checks = [
        (joined.where("known is null"), "unknown path"),
        (joined.where(F.col("known") & ~valid_range(F.col("content"), F.col("start_byte"), F.col("end_byte"))), "invalid range"),
        (findings.where((F.size(labels) > MAX_LABELS) | (F.array_sort(F.array_distinct(labels)) != labels)), "labels unordered, repeated or too many"),
        (dropped, "finding on an unmeasured path"),
        (unmeasured.join(cases.select("path"), "path", "left_anti"), "unknown unmeasured path"),
    ]
    out = None
    for rows, reason in checks:
        part = rows.select("scanner", "path", F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def refuse(violations: DataFrame) -> None:
    """Raise with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in found))
