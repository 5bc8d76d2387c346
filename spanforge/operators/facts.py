"""Rules of representation facts: what a case says about how its text was made, checked against the text and against other cases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.representation import decode_step
from spanforge.sources.store import materialize

#: Names of validities, units, kinds of derivation and steps, and limits.
VALID, SPLIT = "valid", "unpaired-surrogate-split"
UTF8, UTF16 = "utf8-byte", "utf16-code-unit"
AUTHORED, PROJECTION = "authored-base", "projection"
STRIP, NORMALIZE = "strip-codepoints", "normalize"
MAX_BASES = 64
#: Rounds of a chain of derivations; a longer one is a cycle in practice.
MOST_ROUNDS = 1000

VIA = "struct<codec: string, alphabet: string, padding: string, `case`: string, code_points: array<string>>"
RANGE = "struct<start: bigint, end: bigint>"
FACT_SPAN = f"struct<start: bigint, end: bigint, role: string, fragments: array<{RANGE}>, decoded: struct<via: array<{VIA}>, sha256: string, bytes: bigint>>"
REPRESENTATION = "struct<input_validity: string, derivation: struct<kind: string, bases: array<string>>, chunking: struct<unit: string, boundaries: array<bigint>>>"


def _decoded(data: bytes, step: dict) -> bytes | None:
    if step["codec"] != STRIP:
        return decode_step(data, {k: v for k, v in step.items() if v is not None})
    try:
        text = data.decode()
        points = {chr(int(p[2:], 16)) for p in step["code_points"] or []}
    except (UnicodeDecodeError, ValueError):
        return None
    return "".join(c for c in text if c not in points).encode() if points and all(p in text for p in points) else None


def _span_problem(raw: bytes, span: dict) -> str | None:
    boundary = lambda at: 0 <= at <= len(raw) and (at == len(raw) or raw[at] & 0xC0 != 0x80)
    parts = span["fragments"]
    if parts is not None:
        if not all(boundary(p["start"]) and boundary(p["end"]) and p["start"] < p["end"] for p in parts):
            return "fragment is no range of the text"
        if any(b["start"] <= a["end"] for a, b in zip(parts, parts[1:])):
            return "fragments aren't sorted, apart and disjoint"
        if len(parts) < 2 or parts[0]["start"] != span["start"] or parts[-1]["end"] != span["end"]:
            return "fragments don't make up the span"
    decoded = span["decoded"]
    if decoded is not None and not any(s["codec"] == NORMALIZE for s in decoded["via"]):
        value: bytes | None = b"".join(raw[p["start"] : p["end"]] for p in parts or [span])
        for step in decoded["via"]:
            value = None if value is None else _decoded(value, step)
        if value is None:
            return "a decoding doesn't follow from the text"
        if len(value) != decoded["bytes"] or "sha256:" + hashlib.sha256(value).hexdigest() != decoded["sha256"]:
            return "decoded length or digest differs"
    return None


def splits_pair(content: str, boundaries: list[int]) -> bool | None:
    """Whether a boundary in UTF-16 units is inside a surrogate pair; None if one is outside the text."""
    codes = np.frombuffer(content.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(1 + (codes > 0xFFFF))])
    at = np.array(boundaries, np.int64)
    if len(at) and (at.min() < 1 or at.max() >= starts[-1]):
        return None
    return bool((starts[np.searchsorted(starts, at)] != at).any())


def _in_text(content: Column, spans: Column, boundaries: Column) -> Column:
    """struct<spans: array<string>, splits: boolean>: the first problem of each span, and whether UTF-16 boundaries split a pair (null: outside)."""
    kind = pa.struct([("spans", pa.list_(pa.string())), ("splits", pa.bool_())])

    @F.arrow_udf("struct<spans: array<string>, splits: boolean>")
    def check(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in rows:
            out = []
            for text, some, at in zip(*(a.to_pylist() for a in arrays)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out.append({"spans": [x for s in some or [] if (x := _span_problem(raw, s))], "splits": splits_pair(text or "", at) if at is not None else False})
            yield pa.array(out, kind)

    return check(content, spans, boundaries)


def _rising(b: Column) -> Column:
    return F.forall(F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b)), lambda x, y: x < y), lambda x: F.coalesce(x, F.lit(True)))


def text_violations(cases: DataFrame) -> DataFrame:
    """(case_id, reason) of facts of cases (case_id, content, tier, expected, representation) that break a rule or don't follow from the text."""
    r, chunks = F.col("representation"), F.col("representation.chunking")
    bounds, bases = F.col("representation.chunking.boundaries"), F.col("representation.derivation.bases")
    kind, validity = F.col("representation.derivation.kind"), F.col("representation.input_validity")
    factual = F.filter("expected", lambda s: s["fragments"].isNotNull() | s["decoded"].isNotNull())
    utf16 = F.when(chunks["unit"] == UTF16, bounds)
    rows = cases.where(r.isNotNull() | (F.size(factual) > 0)).withColumn("seen", _in_text(F.col("content"), factual, utf16))
    splits = F.col("seen.splits")
    rejected = r.isNotNull() & (validity != VALID)
    outside = F.when(chunks["unit"] == UTF16, splits.isNull()).otherwise(F.exists(bounds, lambda x: (x < 1) | (x >= F.octet_length("content"))))
    counts_fit = lambda s: F.size(s["decoded"]["via"]).between(1, 8) & (s["decoded"]["bytes"] > 0)
    checks = [
        (r.isNotNull() & (validity == VALID) & F.col("representation.derivation").isNull() & chunks.isNull(), "representation without a fact"),
        (F.exists(factual, lambda s: s["role"] != "secret"), "facts of a span that is no secret"),
        (F.exists(factual, lambda s: s["decoded"].isNotNull() & ~counts_fit(s)), "decoding without steps or bytes"),
        (chunks.isNotNull() & (F.size(bounds) < 1), "chunks without a boundary"),
        (chunks.isNotNull() & ~_rising(bounds), "boundaries don't rise"),
        (chunks.isNotNull() & outside, "boundary outside the text"),
        ((validity == VALID) & splits, "a boundary splits a surrogate pair of valid input"),
        ((validity == SPLIT) & ~F.coalesce(splits, F.lit(False)), "no boundary splits a surrogate pair"),
        (rejected & ~validity.isin(SPLIT), "input that no case can carry"),
        (rejected & (F.size("expected") > 0), "a rejection has spans"),
        (rejected & (F.col("tier") != "T0"), "a rejection isn't T0"),
        ((kind == AUTHORED) & (F.size(bases) > 0), "an authored base has bases"),
        ((kind == PROJECTION) & ~F.size(bases).between(1, MAX_BASES), "a projection without bases or with too many"),
        (F.size(F.array_distinct(bases)) < F.size(bases), "a base is named twice"),
    ]
    found = F.concat(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for bad, reason in checks])), "seen.spans")
    return rows.select("case_id", F.explode(F.array_distinct(found)).alias("reason"))


def derivation_violations(cases: DataFrame) -> DataFrame:
    """(case_id, reason) of cases that derive from unknown cases, or from themselves over any number of steps, or from such.

    Cases whose bases are all sound are taken away round by round; what can't be
    taken away leads into a cycle. A round is one pass over the edges that are left,
    which is as many rounds as the longest chain of derivations.
    """
    ids = cases.select("case_id").distinct()
    edges = cases.where("representation.derivation is not null").select("case_id", F.explode("representation.derivation.bases").alias("base")).distinct()
    edges = materialize(edges, "derivations")
    unknown = edges.join(ids.withColumnRenamed("case_id", "base"), "base", "left_anti").select("case_id").distinct()
    left, n = edges.join(unknown.withColumnRenamed("case_id", "u"), F.col("base") == F.col("u"), "left_anti").join(ids.withColumnRenamed("case_id", "base"), "base", "left_semi"), None
    for _ in range(MOST_ROUNDS):
        # An edge stays while its base still has edges of its own.
        left = materialize(left.select("case_id", "base"), "derivations")
        count = left.count()
        if count == n or not count:
            break
        n = count
        left = left.join(left.select(F.col("case_id").alias("base")).distinct(), "base", "left_semi")
    cyclic = left.select("case_id").distinct()
    return unknown.withColumn("reason", F.lit("unknown base")).unionByName(cyclic.withColumn("reason", F.lit("derives from itself")))


def fact_violations(cases: DataFrame) -> DataFrame:
    """(case_id, reason): all violations of representation facts; an empty expected list is an empty array."""
    return text_violations(cases).unionByName(derivation_violations(cases))
