"""SimHash against brute force, with buckets small enough to be split."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spanforge.llm.components import connected_components
from spanforge.llm.simhash import covering_masks, drop_near_duplicates, fingerprint, near_fingerprints, simhash_components


def slow_fingerprint(text):
    words = []
    for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_fingerprint(spark):
    texts = ["", None, "One", "one TWO", "A b C", "É a b c É", "x y z w", "a b c d e f g " * 50, "t\x0bu\x0cv w", "日本 語 テ x"]
    for t in texts:
        assert fingerprint(t) % 2**64 == slow_fingerprint(t)
    df = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert df.h == fingerprint("a b c")


def test_every_triple_is_outside_some_mask():
    for free in (2**64 - 1, 0xF0F0F0F0F0F0F0F0, 0b1011011):
        bits, masks = [i for i in range(64) if free >> i & 1], covering_masks(free)
        rng = random.Random(1)
        for _ in range(3000):
            d = sum(1 << i for i in rng.sample(bits, min(3, len(bits))))
            assert any(m & d == 0 for m in masks)


def test_all_levels_find_all_links(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ 5 << 40 for f in list(fps)[:30]}
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    want = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3])
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for most in (512, 12):
        edges = near_fingerprints(df, max_bucket=most)
        got = {r.node: r.root for r in connected_components(edges).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_components_edge_cases(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    edges = spark.createDataFrame(path + [(1000, 1001), (1001, 1000), (1001, 1001), (7, None), (None, None), (1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).collect() == []


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(12):
        text = [word() for _ in range(300)]
        rows.append((g * 10 + 5, " ".join(text)))
        rows.append((g * 10 + 3, " ".join(text)))
        text[150] = word()
        rows.append((g * 10, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "single"), (None, "single"), (None, "alone alone"), (905, "x" * 200_000), (5, rows[0][1])]
    return rows


def test_documents(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    fps = [slow_fingerprint(t) if t is None or len(t) < 100_000 else fingerprint(t) % 2**64 for _, t in rows]
    label = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = sorted([(i, fps[k], least.get(label[k])) for k, (i, _) in enumerate(rows)], key=repr)
    got = simhash_components(df).collect()
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=repr) == want
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([*least.values(), None, None], key=str)
    assert simhash_components(df.limit(0)).collect() == [] and drop_near_duplicates(df.limit(0)).collect() == []
    assert np.all([isinstance(r.fp, str) for r in kept.collect()])
