"""Embedding near-duplicates by hierarchical navigable small-world graphs, one a shard.

Vectors are dealt into shards of bounded size by a hash, a graph is built in
each, and the vectors of every shard are searched in the graph of every shard:
each pair of shards once, from one of its sides, as links have no direction. A
shard's beam is widened until an audit against brute force finds the wanted
share of known links, and from what it finds near the threshold the search goes
on over the whole region of the graph within reach of the threshold, however large. Links are verified in double
precision; their components are united on Spark.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, join_hot, materialize, release
from spanforge.llm.components import connected_components

THRESHOLD = 0.95
#: A shard holds so many vectors, and so many bytes of them, at most (but for chance: they are dealt by a hash).
SHARD_ROWS = 12_500
SHARD_BYTES = 64 << 20
MIN_SHARDS = 4
#: Vectors travel to the graphs in slices; a task searches those of so many shards in one graph.
SLICE_ROWS = 1024
SOURCES = 4
MOST_PARTITIONS = 20_000
NEIGHBOURS = 16
BUILD_BEAM = 48
BEAM = 64
AUDITED = 128
AUDIT_RECALL = 0.99
LANES = 256
EXPANDED = 4
#: Vectors are compared in single precision first; this much below the threshold still goes to the exact check.
SLACK = 1e-4
#: A region grows over nodes that are this much below the threshold.
MARGIN = 0.1
PAIRS = 1 << 18


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest similarities of each row, in order."""
    if ids.shape[1] > 2 * k:
        part = np.argpartition(-sims, k, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


class Hnsw:
    """A graph over unit vectors (rows of x). Layer 0 holds all nodes, each next one about 1/NEIGHBOURS of the last."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, order: np.ndarray | None = None, counts: list[int] | None = None, scanned: bool = False):
        self.x = np.ascontiguousarray(x, np.float32)
        self.layers, self.order, self.counts, self.scanned = layers or [], order, counts or [], scanned
        if layers is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        level = np.floor(-np.log(1 - np.random.default_rng(7).random(n)) / np.log(NEIGHBOURS)).astype(int)
        self.order = np.lexsort((np.arange(n), -level))
        counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.counts = [c for k, c in enumerate(counts) if k == 0 or c >= 2 * NEIGHBOURS]
        self.layers = [np.full((n, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32) for k in range(len(self.counts))]
        for k in range(len(self.counts) - 1, -1, -1):
            members, done = self.order[: self.counts[k]], 0
            while done < len(members):
                batch = members[done : done + max(64, min(done, 512))]
                self._insert(k, batch, members[:done])
                done += len(batch)

    def _insert(self, k: int, batch: np.ndarray, before: np.ndarray) -> None:
        q = self.x[batch]
        sims = q @ q.T
        np.fill_diagonal(sims, -2)
        near = _best(np.broadcast_to(batch, sims.shape), sims, min(BUILD_BEAM // 2, len(batch)))
        ids, sims = batch[near], np.take_along_axis(sims, near, 1)
        if len(before):
            entry = self._descend(q, k) if k + 1 < len(self.layers) else np.broadcast_to(before[: 2 * NEIGHBOURS], (len(q), min(len(before), 2 * NEIGHBOURS)))
            # Nodes of the layer above are in this one already; what isn't yet is left out.
            there = np.zeros(len(self.x), bool)
            there[before] = True
            entry = np.where(there[entry], entry, before[0])
            found, fsims = self._search_layer(k, q, entry, BUILD_BEAM)
            ids, sims = np.concatenate([found, ids], 1), np.concatenate([fsims, sims], 1)
        chosen = self._diverse(ids, sims, NEIGHBOURS)
        self.layers[k][batch, : chosen.shape[1]] = chosen
        # Back links: each neighbour chooses anew among its own and the new ones.
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        s = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-s, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, int)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        width = self.layers[k].shape[1]
        keep = place < width
        nodes = target[first]
        row = np.searchsorted(nodes, target)
        fresh = np.full((len(nodes), min(width, int(place.max(initial=0)) + 1)), -1, np.int32)
        keep &= place < fresh.shape[1]
        fresh[row[keep], place[keep]] = source[keep]
        for a in range(0, len(nodes), 1024):
            some = nodes[a : a + 1024]
            both = np.concatenate([self.layers[k][some], fresh[a : a + 1024]], 1)
            bs = np.where(both >= 0, np.einsum("ij,ikj->ik", self.x[some], self.x[np.maximum(both, 0)]), -2)
            self.layers[k][some] = self._diverse(both, bs, width, fill_to=width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, m: int, fill_to: int | None = None) -> np.ndarray:
        """Neighbours that are nearer to the node than to any neighbour chosen before; then the nearest of the rest."""
        sims = np.where(ids >= 0, sims, -2)
        top = _best(ids, sims, min(ids.shape[1], 3 * m))
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        sorted_ids = np.argsort(ids, axis=1, kind="stable")
        same = np.zeros(ids.shape, bool)
        ordered = np.take_along_axis(ids, sorted_ids, 1)
        np.put_along_axis(same, sorted_ids[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        valid = (ids >= 0) & ~same & (sims > -2)
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            rival = np.where(chosen, between[:, c, :], -2).max(1)
            take = valid[:, c] & (sims[:, c] > rival) & (count < m)
            chosen[:, c] = take
            count += take
        rest = valid & ~chosen & (np.cumsum(valid & ~chosen, axis=1) <= ((fill_to or m) - count)[:, None])
        rank = np.argsort(~(chosen | rest), axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(np.where(chosen | rest, ids, -1), rank, 1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1).astype(np.int32)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entries into layer ``to`` from the top."""
        top = len(self.layers) - 1
        start = self.order[: min(self.counts[top], 2 * NEIGHBOURS)]
        entry = np.broadcast_to(start, (len(q), len(start)))
        for k in range(top, to, -1):
            entry, _ = self._search_layer(k, q, entry, 8)
        return np.maximum(entry, 0)

    def _search_layer(self, k: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: ids (-1: none) and similarities, the nearest first."""
        graph, x, n = self.layers[k], self.x, len(self.x)
        out_ids, out_sims = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -2, np.float32)
        for a in range(0, len(q), LANES):
            own = q[a : a + LANES]
            lanes = np.arange(len(own))
            seen = np.zeros((len(own), n + 1), bool)  # the last column stands for no node
            seen[:, n] = True
            first = np.unique(entry[a : a + LANES], axis=1) if len(own) == 1 else np.sort(entry[a : a + LANES], axis=1)
            first = np.where(np.diff(first, axis=1, prepend=-1) == 0, n, first)
            ids, sims, open_ = np.full((len(own), ef), n), np.full((len(own), ef), -2, np.float32), np.zeros((len(own), ef), bool)
            fresh = first
            while True:
                known = seen[lanes[:, None], fresh]
                seen[lanes[:, None], fresh] = True
                fresh = np.where(known, n, fresh)
                s = np.einsum("ij,ikj->ik", own[lanes], x[np.minimum(fresh, n - 1)])
                s[fresh == n] = -2
                all_ids, all_sims = np.concatenate([ids, fresh], 1), np.concatenate([sims, s], 1)
                all_open = np.concatenate([open_, fresh < n], 1)
                top = _best(all_ids, all_sims, ef)
                ids, sims, open_ = (np.take_along_axis(t, top, 1) for t in (all_ids, all_sims, all_open))
                ended = ~open_.any(1)
                if ended.any():
                    out_ids[a + lanes[ended]], out_sims[a + lanes[ended]] = np.where(ids[ended] == n, -1, ids[ended]), sims[ended]
                    live = ~ended
                    lanes, ids, sims, open_ = lanes[live], ids[live], sims[live], open_[live]
                    if not len(lanes):
                        break
                pick = np.argsort(~open_, axis=1, kind="stable")[:, :EXPANDED]
                real = np.take_along_axis(open_, pick, 1)
                np.put_along_axis(open_, pick, False, 1)
                nodes = np.where(real, np.take_along_axis(ids, pick, 1), 0)
                fresh = np.where(real[:, :, None], graph[nodes], -1).reshape(len(lanes), -1)
                fresh = np.sort(np.where(fresh < 0, n, fresh), axis=1)
                fresh = np.where(np.diff(fresh, axis=1, prepend=-1) == 0, n, fresh)
        return out_ids, out_sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        ef = min(ef, len(self.x))
        return self._search_layer(0, q, self._descend(q, 0), ef)

    def audit(self, threshold: float, beam: int, recall: float) -> tuple[int, float]:
        """(beam, share): the beam, doubled until the share of known links found is ``recall`` at least.

        The queries are stored vectors turned away to just within the threshold,
        the links known are those of a scan. If even a beam over all nodes misses
        too many, the graph doesn't reach them: the shard is marked as scanned.
        """
        n = len(self.x)
        some = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(int))
        noise = np.random.default_rng(11).standard_normal((len(some), self.x.shape[1]))
        x = self.x[some].astype(np.float64)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-30)
        c = min(1.0, threshold + 0.002)
        q = (c * x + np.sqrt(1 - c * c) * noise).astype(np.float32)
        truth = q @ self.x.T >= threshold
        while True:
            hit = sum(int(truth[r, n_].sum()) for r, n_ in self.within(q, threshold, beam))
            share = hit / max(1, int(truth.sum()))
            if hit >= recall * truth.sum():
                return beam, share
            if beam >= n:
                self.scanned = True
                return beam, share
            beam *= 2

    def within(self, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) of pairs with a similarity of the threshold or more, each once, in parts of ``LANES`` queries at most."""
        for a in range(0, len(q) if self.scanned else 0, LANES):
            r, c = np.nonzero(q[a : a + LANES] @ self.x.T >= threshold)
            yield a + r, c
        if self.scanned or not len(q):
            return
        ids, sims = self.search(q, beam)
        near = sims >= threshold - MARGIN
        rest = np.flatnonzero(near.any(1))
        rest = rest[np.argsort(np.where(near[rest], ids[rest], len(self.x)).min(1), kind="stable")]
        for a in range(0, len(rest), LANES):
            some = rest[a : a + LANES]
            r, c = self._region(q[some], np.unique(ids[some][near[some]]), threshold)
            yield some[r], c

    def _region(self, q: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a few queries with all nodes that a walk from ``nodes`` reaches without leaving their neighbourhood.

        The beam without a bound, shared by the queries: what one of them reaches is compared with all.
        """
        seen = np.zeros(len(self.x), bool)
        seen[nodes] = True
        rows, found = [], []
        while len(nodes):
            grown = []
            for a in range(0, len(nodes), 4096):
                part = nodes[a : a + 4096]
                sims = q @ self.x[part].T
                r, c = np.nonzero(sims >= threshold)
                rows.append(r)
                found.append(part[c])
                grown.append(part[sims.max(0) >= threshold - MARGIN])
            near = np.unique(self.layers[0][np.concatenate(grown)])
            near = near[near >= 0]
            nodes = near[~seen[near]]
            seen[nodes] = True
        return np.concatenate(rows), np.concatenate(found)


# ---------------------------------------------------------------- on Spark


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_BUILT = "dim int, shard int, shards int, seq int, beam int, recall double, scanned boolean, data binary"
_DEALT = ("dim", "shard", "shards", "node", "copies", "vector")


def _build(threshold: float):
    """Over rows sorted by shard: each shard's graph (seq -1) and its vectors in slices (seq from 0)."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            shard = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")], 1)
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]).any(1)) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and key != tuple(shard[a]):
                    yield from built(held)
                    held = []
                key = tuple(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from built(held)
        release()

    def built(batches):
        t = pa.Table.from_batches(batches)
        dim, shard, shards = (t.column(c)[0].as_py() for c in ("dim", "shard", "shards"))
        x = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False) for b in batches]).reshape(-1, dim)
        single = x.astype(np.float32)
        x = single if (single == x).all() else x
        node = np.array(t.column("node").to_pylist(), dtype="S32")
        copies = t.column("copies").to_numpy()
        index = Hnsw(_unit(x))
        beam, recall = index.audit(threshold, BEAM, AUDIT_RECALL)
        layers = {f"layer{k}": g for k, g in enumerate(index.layers)}
        parts = [_packed(x=x, node=node, copies=copies, order=index.order, counts=np.array(index.counts), beam=np.array(beam), scanned=np.array(index.scanned), **layers)]
        parts += [_packed(x=x[a : a + SLICE_ROWS], node=node[a : a + SLICE_ROWS], copies=copies[a : a + SLICE_ROWS]) for a in range(0, len(x), SLICE_ROWS)]
        for k, data in enumerate(parts):
            row = [[dim], [shard], [shards], [k - 1], [beam], [recall], [index.scanned], [data]]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k_) for v, k_ in zip(row, types)], ["dim", "shard", "shards", "seq", "beam", "recall", "scanned", "data"])

    return run


class _Shard:
    """A graph that slices of vectors are searched in: it keeps counts and a forest of what was found, not the pairs."""

    def __init__(self, data: bytes, threshold: float):
        with np.load(io.BytesIO(data)) as z:
            self.node, self.copies, self.unit = z["node"], z["copies"], _unit(z["x"])
            counts = z["counts"].tolist()
            self.index = Hnsw(self.unit, [z[f"layer{k}"] for k in range(len(counts))], z["order"], counts, bool(z["scanned"]))
            self.beam = int(z["beam"])
        self.threshold = threshold
        self.links = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))

    def search(self, data: bytes, own: int | None) -> pa.RecordBatch:
        """Search a slice. ``own``: where it begins in this very shard; its links are then found from both ends."""
        with np.load(io.BytesIO(data)) as z:
            unit, node, copies = _unit(z["x"]), z["node"], z["copies"]
        links, tied = np.zeros(len(node), np.int64), np.full(len(node), -1)
        for q, n in self.index.within(unit.astype(np.float32), self.threshold - SLACK, self.beam):
            good = np.ones(len(q), bool) if own is None else q + own != n
            for a in range(0, len(q), PAIRS):
                part = slice(a, a + PAIRS)
                good[part] &= np.einsum("ij,ij->i", unit[q[part]], self.unit[n[part]]) >= self.threshold
            q, n = q[good], n[good]
            if not len(q):
                continue
            links += np.bincount(q, self.copies[n], len(node)).astype(np.int64)
            if own is None:
                self.links += np.bincount(n, copies[q], len(self.node)).astype(np.int64)
            else:
                q, n = np.concatenate([q, q]), np.concatenate([n, q + own])
            order = np.argsort(q, kind="stable")
            q, n = q[order], n[order]
            some, first = np.unique(q, return_index=True)
            self._unite(n, first, np.repeat(np.arange(len(some)), np.diff(np.r_[first, len(q)])))
            tied[some] = n[first]
        found = np.flatnonzero(links)
        if own is not None:
            return _rows(node[found], None, links[found])
        return _rows(node[found], self.node[self.label[tied[found]]], links[found])

    def _unite(self, n: np.ndarray, first: np.ndarray, row: np.ndarray) -> None:
        """All nodes n of a query are one component; a label is the component's least node."""
        while True:
            now = self.label[n]
            least = np.minimum.reduceat(now, first)[row]
            if (now == least).all():
                return
            np.minimum.at(self.label, now, least)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def finished(self) -> pa.RecordBatch:
        """What the searches left with the shard's own vectors."""
        found = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.node))))
        return _rows(self.node[found], self.node[self.label[found]], self.links[found])


def _rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    a = a.astype(str).tolist()
    b = [None] * len(a) if b is None else b.astype(str).tolist()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _search(threshold: float):
    """Over rows sorted by target, the graph before the slices: (a, b, n), n links of a with others, and b in the same component."""

    def run(batches):
        shard, key = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "target", "part", "shard", "seq")]
            for i, (dim, target, part, source, seq) in enumerate(zip(*columns)):
                data = batch.column("data")[i].as_buffer().to_pybytes()
                if seq < 0:
                    if shard is not None:
                        yield shard.finished()
                    shard, key = _Shard(data, threshold), (dim, target, part)
                elif key == (dim, target, part):  # else the target is a shard without vectors
                    yield shard.search(data, seq * SLICE_ROWS if source == target else None)
        if shard is not None:
            yield shard.finished()
        release()

    return run


def _usable(vector: Column, id_: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, no zero norm."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(id_.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def build_shards(nodes: DataFrame, *, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, shards, seq, beam, recall, scanned, data): a row with the graph of each shard (seq -1), and its vectors in slices.

    ``nodes``: node (up to 32 ASCII letters), copies, vector (array<double>),
    dim. Every shard is built in a task of its own and holds at most about
    ``shard_rows`` vectors and ``SHARD_BYTES`` of them. ``beam``, ``recall`` and
    ``scanned`` say how its audit ended.
    """
    spark = nodes.sparkSession
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.select("dim", F.greatest(F.lit(MIN_SHARDS), F.ceil(F.col("n") / most)).cast("int").alias("shards")), "shard-sizes")
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).select(*_DEALT)
    place = F.pmod(F.col("shard") + F.hash("dim"), F.lit(min(total, MOST_PARTITIONS))).cast("int")
    dealt = dealt.repartitionById(min(total, MOST_PARTITIONS), place).sortWithinPartitions("dim", "shard", "node")
    return materialize(dealt.mapInArrow(_build(threshold), _BUILT), "hnsw", "lz4")


def search_shards(built: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n): n links of node a, and a node b of its component (or null); a node's counts are summed over its rows.

    The vectors of shard s are searched in the graph of shard t for s = t and
    for one of (s, t), (t, s): s < t if their sum is even, s > t if it is odd,
    so that every graph serves half of the shards. A task holds a graph and a slice.
    """
    sources = F.col("shards")
    pairs = built.where("seq >= 0").withColumn("target", F.explode(F.sequence(F.lit(0), sources - 1)))
    even = (F.col("shard") + F.col("target")) % 2 == 0
    pairs = pairs.where((F.col("shard") == F.col("target")) | ((F.col("shard") < F.col("target")) == even))
    pairs = pairs.withColumn("part", F.floor(F.col("shard") / SOURCES).cast("int"))
    parts = F.sequence(F.lit(0), F.floor((sources - 1) / SOURCES).cast("int"))
    graphs = built.where("seq < 0").withColumn("target", F.col("shard")).withColumn("part", F.explode(parts))
    columns = ["dim", "shards", "target", "part", "shard", "seq", "data"]
    rows = graphs.select(columns).unionByName(pairs.select(columns))
    tasks = built.where("seq < 0").agg(F.sum(F.floor((sources - 1) / SOURCES) + 1)).first()[0] or 1
    n = int(min(tasks, MOST_PARTITIONS))
    number = F.col("target") * (F.floor((sources - 1) / SOURCES) + 1) + F.col("part") + F.hash("dim")
    rows = rows.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions("dim", "target", "part", "seq")
    return rows.mapInArrow(_search(threshold), "a string, b string, n bigint")


def embedding_links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows link if the cosine of their vectors, in double precision, is
    ``threshold`` or more. ``n_links`` is the number of other rows linked
    directly, ``component_id`` the least id reachable, and ``kept`` whether that
    is the row's own. Rows with equal vectors are one node with a number of
    copies from the start, and links leave a task as counts and a spanning
    forest: a group of copies is never expanded into pairs, and within a task
    pairs are held for ``LANES`` queries at a time. A null, zero, non-finite or
    empty vector links with nothing and is its own component; so is a row
    without an id (its component_id is null and it isn't kept). Vectors of
    different lengths don't link. Components very large or small in size count
    by their direction alone. All pairs of shards are searched: n * n /
    ``shard_rows`` searches, by the method.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).withColumn("ok", _usable(F.col("vector"), F.col("id")))
    node = F.when(F.col("ok"), F.concat(F.lpad(F.hex(F.xxhash64("vector")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("vector"), "vector")), 16, "0")))
    rows = rows.withColumn("node", node)
    members = materialize(rows.select("id", "node"), "vector-nodes")
    nodes = rows.where("ok").groupBy("node").agg(F.count("*").alias("copies"), F.any_value("vector").alias("vector")).withColumn("dim", F.size("vector"))
    nodes = materialize(nodes, "vectors")
    built = build_shards(nodes, threshold=threshold, shard_rows=shard_rows)
    found = materialize(search_shards(built, threshold=threshold), "vector-links")
    discard(nodes, built)
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = (
        members.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        .join(counts, F.col("node") == counts.a, "left")
        .join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
        .select("node", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    named = materialize(named, "vector-roots")
    leasts = materialize(named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), "vector-components")
    found = materialize(join_hot(named, leasts, "root").select("node", "n_links", "component", F.col("copies").alias("n")), "vector-components")
    alone = members.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    linked = join_hot(members.where("node is not null"), found, "node").select("id", "n_links", "component")
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"),
    )
