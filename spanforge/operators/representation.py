"""Facts about how a case's text was made: decoded secrets, fragments and chunks, checked against the text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.codecs import base64_strict

STEP = "struct<codec:string,alphabet:string,padding:string,`case`:string>"


def decode_step(data: bytes, step: dict) -> bytes | None:
    """One declared decoding; None where the bytes aren't what the step declares."""
    codec = step.get("codec")
    if codec == "base64":
        try:
            return base64_strict(data.decode("ascii"), step.get("alphabet") == "url-safe", step.get("padding", "padded") == "padded")
        except UnicodeDecodeError:
            return None
    if codec == "hex":
        try:
            text = data.decode("ascii")
            out = bytes.fromhex(text) if text and len(text) % 2 == 0 and text.isalnum() else None
        except (UnicodeDecodeError, ValueError):
            return None
        lower, upper = any("a" <= c <= "f" for c in text), any("A" <= c <= "F" for c in text)
        fits = {"lower": not upper, "upper": not lower, "mixed": lower and upper}[step.get("case", "lower")]
        return out if fits else None
    return None


def decoded_matches(content: Column, fragments: Column, steps: Column, sha256: Column, n_bytes: Column) -> Column:
    """Whether the fragments (array of start, end bytes) of a text, put together and decoded step by step, have the digest and length stated."""

    @F.arrow_udf("boolean")
    def check(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in rows:
            out = []
            for text, parts, via, digest, size in zip(*(a.to_pylist() for a in arrays)):
                if text is None or via is None:
                    out.append(None)
                    continue
                raw = text.encode()
                data: bytes | None = b"".join(raw[p["start"] : p["end"]] for p in parts or [])
                for step in via:
                    data = decode_step(data, {k: v for k, v in step.items() if v is not None}) if data is not None else None
                out.append(data is not None and len(data) == size and hashlib.sha256(data).hexdigest() == digest)
            yield pa.array(out, pa.bool_())

    return check(content, fragments, steps, sha256, n_bytes)


def chunk_problems(chunks: DataFrame) -> DataFrame:
    """(case_id, reason) of chunk boundaries (content, boundaries: byte offsets) that don't rise, lie outside the text or cut a code point."""
    b = F.col("boundaries")
    raw = F.encode("content", "UTF-8")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), lambda i: (i >= F.size(b)) | (F.try_element_at(b, i) < F.try_element_at(b, i + 1)))
    inside = F.forall(b, lambda x: (x > 0) & (x < F.octet_length(raw)))
    whole = F.forall(b, lambda x: F.is_valid_utf8(F.substring(raw, F.lit(1), x.cast("int")).cast("string")))
    reason = F.when(~rising, "not rising").when(~inside, "outside the text").when(~whole, "inside a code point")
    return chunks.withColumn("reason", reason).where("reason is not null").select("case_id", "reason")


def representation_report(facts: DataFrame) -> DataFrame:
    """One row of counters over facts (case_id, decoded, n_fragments, validity, derivation)."""
    return facts.agg(
        F.count("*").alias("spans"),
        F.count_distinct("case_id").alias("cases"),
        F.sum(F.col("decoded").cast("long")).alias("decoded"),
        F.sum((F.col("n_fragments") > 1).cast("long")).alias("fragmented"),
        F.sum((F.col("validity") != "valid").cast("long")).alias("rejected"),
        F.sum((F.col("derivation") == "projection").cast("long")).alias("projections"),
    )


