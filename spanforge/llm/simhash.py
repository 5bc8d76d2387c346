"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a fingerprint gets a nonzero vector of r + 1 bits; each of the
2**(r + 1) - 1 nonzero vectors v makes a mask of the bits whose vector has an
odd product with v. The vectors of r differing bits span at most r dimensions,
so that some v is orthogonal to all of them: under its mask the two
fingerprints are equal. Every pair within the radius collides in some table.

A bucket with more than ``MAX_BUCKET`` distinct fingerprints isn't compared
pair by pair: its bits outside the mask are covered in the same way again,
which splits it by about half of them and loses no pair either. After three
levels under ten bits are free, so that a bucket holds under ``MAX_BUCKET``
fingerprints, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import join_hot, materialize, slices, unused
from spanforge.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
BITS = 64
MAX_BUCKET = 512
FEW_BITS = 9  # a bucket with so few bits free has at most MAX_BUCKET fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8))


def majority(digests: np.ndarray) -> int:
    """The signed number of the bits that are set in over half of the digests (eight bytes each); 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(digests), 100_000):
        ones += np.unpackbits(digests[a : a + 100_000], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big", signed=True)


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text (null: empty), which tell rows with one id apart."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("text"), text).alias("text_b")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_a, text_b, fp) for every row; a null text has the fingerprint of an empty one, zero."""

    def run(batches):
        for part in slices(batches, "text"):
            fps = pa.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_a"), part.column("text_b"), fps], ["id", "text_a", "text_b", "fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *text_key(text), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_a bigint, text_b bigint, fp bigint")


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of these bits are outside one mask at least."""
    bits = [i for i in range(BITS) if free >> i & 1]
    n = 2 ** (radius + 1) - 1
    vector = {i: k % n + 1 for k, i in enumerate(bits)}
    return [sum(1 << i for i in bits if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _unsigned(x: int) -> int:
    return x & ((1 << BITS) - 1)


def _literal_masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _forest(segment: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare all pairs within each segment; edges from each linked fingerprint to one of its component."""
    n = len(fps)
    label = np.arange(n)
    left, right, alive, d = [], [], np.arange(n), 1
    while len(alive := alive[alive + d < n]) and len(alive := alive[segment[alive] == segment[alive + d]]):
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + d]) <= radius]
        left.append(near)
        right.append(near + d)
        d += 1
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked].view(np.int64), fps[label[linked]].view(np.int64)


def _compare(radius: int):
    """Over rows sorted by bucket: the edges of each bucket, a batch and the last bucket's start at a time."""

    def run(batches):
        kept = None
        for batch in batches:
            mask, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp"))
            rows = np.stack([mask, key, fp])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            if not rows.shape[1]:
                continue
            start = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)])
            yield from edges(rows[:, : start[-1]])
            kept = rows[:, start[-1] :]
        if kept is not None:
            yield from edges(kept)

    def edges(rows):
        if rows.shape[1] > 1:
            segment = np.cumsum(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)])
            a, b = _forest(segment, rows[2].view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): edges between distinct fingerprints (fp) with the components of all pairs within ``radius`` bits.

    Not every pair is returned, but a spanning forest of each bucket's pairs.
    """
    spark = distinct.sparkSession
    level = [(0, covering_masks(2**BITS - 1, radius))]
    rows = distinct.withColumn("mask", F.explode(_literal_masks(level[0][1])))
    found = None
    while True:
        keyed = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = materialize(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")
        few = (F.col("n") <= max_bucket) | (F.bit_count("mask") >= BITS - FEW_BITS)
        small = sized.where(few).select("mask", "key", "fp")
        edges = small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_compare(radius), "a bigint, b bigint")
        found = edges if found is None else found.unionByName(edges)
        large = sized.where(~few).select("mask", "fp")
        if large.isEmpty():
            return found
        # The masks of the next level are few and fixed: 15 for each mask of this one.
        masks = [m for _, ms in level for m in ms]
        level = [(m, [m | x for x in covering_masks(~m & (2**BITS - 1), radius)]) for m in dict.fromkeys(masks) if m != 2**BITS - 1]
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in ms]) for m, ms in level], "mask bigint, finer array<bigint>")
        rows = large.join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, max_bucket: int) -> DataFrame:
    """(id, text_a, text_b, fp, component_id, first): first is the component's row with the least id, as a row key."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(row_key()).alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    roots = connected_components(near_fingerprints(distinct.select("fp"), radius, max_bucket))
    linked = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rows", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    firsts = materialize(linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "simhash-components")
    named = materialize(join_hot(linked.select("fp", "rows", "root"), firsts, "root").select("fp", F.col("component").alias("first"), F.col("rows").alias("n")), "simhash-components")
    return join_hot(prints, named, "fp").withColumn("component_id", F.col("first.id"))


def row_key() -> Column:
    """Orders rows by id, those without one last, and tells rows with equal ids and different texts apart."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_a", "text_b")


def simhash_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked, and
    ``component_id`` is the least id reachable. Copies share a fingerprint and
    are carried once from there on. Null and empty texts have fingerprint zero
    and are linked like others; null ids take part, but are no component's id
    unless all of a component's ids are null. Repeated rows stay.
    """
    return _grouped(docs, id_col, text_col, radius, shingle, max_bucket).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keep one row of each component of ``groups`` (id, text_a, text_b, first): that with the least id. Columns stay as they came.

    A row is known by its id and its text, so that rows with one id and
    different texts are rows of their own; of rows that agree in both one stays.
    Rows without an id come last in their component and all stay.
    """
    flagged = groups.where("id is not null").select("id", "text_a", "text_b", (row_key() == F.col("first")).alias("own"))
    counted = materialize(flagged.groupBy("id", "text_a", "text_b").agg(F.max("own").alias("own"), F.count("*").alias("n")), "near-duplicates")
    row_id, one, two = unused(docs.columns, "row_id", "one", "two")
    key = [F.col("id").alias(row_id), F.col("text_a").alias(one), F.col("text_b").alias(two)]
    # Fewer rows go than stay, so the joins are with those that go or repeat: texts are shuffled only if even these are many.
    gone = materialize(counted.where("not own").select(key), "gone")
    repeated = materialize(counted.where("own and n > 1").select(key), "repeated")
    a, b = text_key(docs[f"`{text_col}`"])
    same = lambda other: (docs[f"`{id_col}`"] == other[row_id]) & (a == other[one]) & (b == other[two])
    out = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return out
    once = docs.join(repeated, same(repeated), "left_semi").withColumns({one: a, two: b}).dropDuplicates([id_col, one, two]).drop(one, two)
    return out.join(repeated, same(repeated), "left_anti").unionByName(once)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Keep one row of each group of near duplicates, as ``keep_first`` does."""
    return keep_first(docs, _grouped(docs, id_col, text_col, radius, shingle, max_bucket), id_col, text_col)
