"""Near copies by the Jaccard similarity of five-word shingles, on top of SimHash.

Candidates come from covering SimHash over the shingles, which finds pairs
within three bits for certain, and, as pairs at similarity 0.8 lie up to a dozen
bits apart, from MinHash: documents with equal minima in all rows of a band
share a bucket. A pair at similarity s misses all buckets with probability
(1 - s**ROWS)**BANDS, 8e-5 at 0.8 and less above.

Of each bucket the document that shares most buckets with others is the centre.
Every candidate is compared with the best of its centres, then, where a bucket
isn't one component yet, with its centre there, by their whole sets. What is
left over in a bucket (all but its largest component) is compared with the whole
bucket in blocks if it is up to ``MAX_BUCKET`` documents; larger rests are banded
again by other hash functions, which parts what is dissimilar, up to ``LEVELS``
times. Only verified pairs link.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, join_hot, materialize, slices
from spanforge.llm.components import connected_components
from spanforge.llm.simhash import RADIUS, keep_first, majority, near_fingerprints, row_key, text_key

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
BLOCK = 2000
MAX_BUCKET = 256
LEVELS = 4
#: Members of a bucket that its rest is compared with in one group.
SLICE = 2048
#: Comparisons with one document that go to one task.
SHARE = 64


@lru_cache(LEVELS + 1)
def _functions(level: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42 + level)
    factors = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(shingle, len(words))
    if not size:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in words]), ">u8").astype(np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def band_keys(hashes: np.ndarray, level: int = 0) -> np.ndarray:
    """One key a band, of the minima of its rows."""
    factors, terms = _functions(level)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[a : a + BLOCK, None] * factors + terms).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, text_a, text_b, digest of the set, SimHash, keys of the bands) for every row (id, text_a, text_b, text)."""
    kept = ("id", "text_a", "text_b")

    def run(batches):
        for part in slices(batches, "text"):
            found = [shingles(t, shingle) for t in part.column("text").to_pylist()]
            keys = pa.array(np.concatenate([band_keys(x) for x in found]), pa.int64())
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, keys)
            fps = pa.array([majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([_digest(x) for x in found], pa.binary()), fps, lists], [*kept, "digest", "fp", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_a bigint, text_b bigint, digest binary, fp bigint, keys array<bigint>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(digest, hashes) of texts."""

    def run(batches):
        for part in slices(batches, "text"):
            found = [shingles(t, shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["digest", "hashes"])

    return rows.mapInArrow(run, "digest binary, hashes binary")


def _similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two packed sets are similar; sizes that forbid it aren't looked at."""

    @F.arrow_udf("boolean")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    n, m = F.octet_length(a), F.octet_length(b)
    return F.when(F.least(n, m) >= F.lit(similarity - 1e-6) * F.greatest(n, m), compare(a, b)).otherwise(False)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, as a table. A document b with very many partners is sent once for each ``SHARE`` of them."""
    pairs = materialize(pairs, "shingle-pairs")
    partners = materialize(pairs.groupBy("b").agg(F.count("*").alias("n")), "shingle-partners")
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    dealt = join_hot(pairs, partners, "b").withColumn("share", F.pmod(F.xxhash64("a"), shares).cast("int"))
    b = partners.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes")), "b").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes"))
    both = dealt.select("a", "b", "share").join(b.select("b", "share", "b_hashes"), ["b", "share"]).join(a, "a")
    found = materialize(both.where(_similar(F.col("a_hashes"), F.col("b_hashes"), similarity)).select("a", "b"), "shingle-verified")
    discard(pairs, partners)
    return found


def _compare(similarity: float):
    """Over rows sorted by group, the rest before the members: a link (a, b) of each of the rest with each component that it reaches."""

    def run(batches):
        group, rest, members = None, {}, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "node", "root")]
            for k, (*g, side, node, root) in enumerate(zip(*columns)):
                if g != group:
                    yield from links(rest, members)
                    group, rest, members = g, {}, {}
                hashes = np.frombuffer(batch.column("hashes")[k].as_buffer(), np.uint64)
                (members if side else rest)[node] = (root, hashes)
        yield from links(rest, members)

    def links(rest, members):
        if not rest or not members:
            return
        names, roots = np.array(list(members), np.int64), np.array([r for r, _ in members.values()], np.int64)
        sets = [h for _, h in members.values()]
        sizes = np.array([len(h) for h in sets])
        universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark, starts = np.zeros(len(universe), bool), np.cumsum(sizes) - sizes
        a, b = [], []
        for node, (root, own) in rest.items():
            at = np.searchsorted(universe, own)
            at = at[at < len(universe)]
            at = at[np.isin(universe[at], own, assume_unique=True)]
            mark[at] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[at] = False
            near = np.flatnonzero((both >= similarity * (len(own) + sizes - both) - 1e-9) & (roots != root))
            near = near[np.unique(roots[near], return_index=True)[1]]
            a += [node] * len(near)
            b += names[near].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of the rest of each bucket with all its members: (bucket, node, root, is_rest, n, k), n members, k of them the rest.

    Blocks of ``MAX_BUCKET`` of the rest meet slices of ``SLICE`` members, each pair of them in a group of its own.
    """
    blocks, parts = F.ceil(F.col("k") / MAX_BUCKET).cast("int"), F.ceil(F.col("n") / SLICE).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["bucket", "node", "root"]
    rest = members.where("is_rest").select(*own, F.lit(0).alias("side"), place(blocks).alias("i"), upto(parts).alias("j"))
    every = members.select(*own, F.lit(1).alias("side"), upto(blocks).alias("i"), place(parts).alias("j"))
    rows = rest.unionByName(every).join(sets, "node")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_compare(similarity), "a bigint, b bigint")


def _bands(level: int):
    @F.arrow_udf("array<bigint>")
    def keys(hashes: pa.Array) -> pa.Array:
        return pa.array([band_keys(np.frombuffer(x.as_buffer(), np.uint64), level) for x in hashes], pa.list_(pa.int64()))

    return keys(F.col("hashes"))


def _shared(keyed: DataFrame) -> DataFrame:
    """(bucket, node, degree, center): the rows of buckets with several nodes, one of buckets with the same nodes.

    A node's degree is the number of rows that it shares buckets with, and a bucket's centre the node of the largest.
    """
    keyed = materialize(keyed, "shingle-keys")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit("node"), "node").cast("decimal(38,0)")).alias("y")).where("n > 1")
    sizes = materialize(sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "shingle-buckets")
    shared = materialize(join_hot(keyed, sizes, "bucket"), "shingle-members")
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    shared_2 = materialize(shared.join(degrees, "node"), "shingle-degrees")
    discard(keyed, sizes, shared)
    centers = materialize(shared_2.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("center"), F.count("*").alias("n")), "shingle-centers")
    out = materialize(join_hot(shared_2.select("bucket", "node", "degree"), centers, "bucket"), "shingle-shared")
    discard(shared_2, centers)
    return out


def _edges(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _named(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, buckets): the rows of buckets of several components with their roots, and n and k of these buckets."""
    named = materialize(shared.join(roots, "node", "left").select("bucket", "node", "center", F.coalesce("root", "node").alias("root")), "shingle-named")
    parts = named.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = materialize(mixed.select("bucket", "n", "main", (F.col("n") - F.col("most")).alias("k")), "shingle-mixed")
    members = materialize(join_hot(named, mixed, "bucket").withColumn("is_rest", F.col("root") != F.col("main")), "shingle-members")
    discard(named)
    return members, mixed


def _links(distinct: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): the components of the verified pairs among the distinct sets."""
    equal = distinct.select(F.xxhash64(F.lit("fp"), "fp").alias("bucket"), "node")
    shared = _shared(distinct.select(F.explode("keys").alias("bucket"), "node").unionByName(equal))
    holders = materialize(distinct.groupBy("fp").agg(F.min("node").alias("holder")), "shingle-fingerprints")
    near = near_fingerprints(holders.select("fp"), RADIUS)
    ends = [holders.select(F.col("fp").alias(c), F.col("holder").alias(f"{c}_node")) for c in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    near = materialize(near, "shingle-near")
    nodes = shared.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(distinct.join(nodes, "node").select("node", "digest", "first.*"), "shingle-candidates")
    key = wanted.select(F.col("id").alias("w_id"), F.col("text_a").alias("w_a"), F.col("text_b").alias("w_b"))
    same = rows["id"].eqNullSafe(F.col("w_id")) & (rows["text_a"] == F.col("w_a")) & (rows["text_b"] == F.col("w_b"))
    found = _sets(rows.join(key, same, "left_semi").select("text"), shingle)
    sets = materialize(found.join(wanted.select("node", "digest"), "digest").select("node", "hashes").dropDuplicates(["node"]), "shingle-hashes")
    discard(holders, wanted)
    roots, level = None, 0
    while True:
        best = shared.where("node <> center.node").groupBy(F.col("node").alias("a")).agg(F.max("center").alias("c")).select("a", F.col("c.node").alias("b"))
        links = _verified(best.unionByName(near).distinct() if roots is None else best, sets, similarity)
        roots = _joined(roots, links)
        members, mixed = _named(shared, roots)
        others = members.where("node <> center.node").select(F.col("node").alias("a"), F.col("center.node").alias("b"), "root")
        others = others.join(roots.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b", "left").where("root <> coalesce(b_root, b)").select("a", "b").distinct()
        links = _verified(others, sets, similarity)
        discard(members, mixed)
        roots = _joined(roots, links)
        members, mixed = _named(shared, roots)
        large = F.lit(level < LEVELS) & (F.col("k") > MAX_BUCKET)
        links = materialize(_in_blocks(members.where(~large), sets, similarity), "shingle-verified")
        roots = _joined(roots, links)
        finer = members.where(large)
        if finer.isEmpty():
            discard(members, mixed, shared, near, sets)
            return roots
        level += 1
        keys = finer.join(sets, "node").select("bucket", "node", F.explode(_bands(level)).alias("key"))
        again = _shared(keys.select(F.xxhash64("bucket", "key").alias("bucket"), "node"))
        discard(members, mixed, shared)
        shared = again


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of those before and more links; both tables go. Without links they are those before."""
    if roots is not None and links.isEmpty():
        discard(links)
        return roots
    edges = links if roots is None else _edges(roots).unionByName(links)
    out = materialize(connected_components(edges), "shingle-roots")
    discard(links, *([] if roots is None else [roots]))
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, text_a, text_b, first) for every row: first is the row key of the component's least row."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *text_key(text), text.alias("text"))
    prints = materialize(_prints(rows, shingle), "shingle-prints")
    distinct = prints.groupBy("digest").agg(F.min(row_key()).alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count("*").alias("rows"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    kept = materialize(prints.select("id", "text_a", "text_b", "digest"), "shingle-rows")
    discard(prints)
    roots = _links(distinct, rows, shingle, similarity)
    named = distinct.join(roots, "node", "left").select("digest", "rows", "first", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "shingle-named")
    firsts = materialize(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "shingle-firsts")
    named = materialize(join_hot(named.select("digest", "rows", "root"), firsts, "root").select("digest", F.col("component").alias("first"), F.col("rows").alias("n")), "shingle-components")
    discard(distinct, roots)
    return join_hot(kept, named, "digest")


def shingle_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) for every row: the least id reachable over pairs at ``similarity`` or more.

    Words are compared without ASCII case and as split by ASCII spaces. Texts
    of equal shingles are carried once. Null and empty texts are copies of each
    other. Null ids take part, but are no component's id unless all of a
    component's ids are null. Repeated rows stay.
    """
    return _grouped(docs, id_col, text_col, shingle, similarity).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Keep one row of each group of near copies, as ``keep_first`` does."""
    return keep_first(docs, _grouped(docs, id_col, text_col, shingle, similarity), id_col, text_col)
