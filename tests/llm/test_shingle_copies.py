"""Near copies of the pipeline against brute force over all pairs."""

import random
from collections import defaultdict

import corpus_pipeline
from spanforge.llm import shingle_copies
from spanforge.llm.shingle_copies import drop_near_copies, shingle_components
from spanforge.llm.simhash import drop_near_duplicates

SF = "/root/testdata/sf0.01/documents.parquet"


def grams(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute(texts):
    """Labels over all pairs of five-word Jaccard 0.8, and these pairs of unequal sets."""
    sets, holders = [grams(t) for t in texts], defaultdict(list)
    pairs, label, least = [], list(range(len(texts))), {}
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        least.setdefault(s, i)
        pairs += [(j, i) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)] + [(least[s], i)] * (not s)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label, [p for p in pairs if sets[p[0]] != sets[p[1]]]


def test_every_pair_of_whole_data_is_found(spark, tmp_path):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF).orderBy("doc_id").collect()]
    for i, text in rng.sample(rows, 150):
        words = (text or "").split(" ")
        for k in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[k] = f"edited{rng.randrange(10**6)}"
        rows.append((100_000 + i, " ".join(words)))
    rows += [(200_000, None), (200_001, ""), (200_002, " \n")]
    label, pairs = brute([t for _, t in rows])
    assert len(pairs) > 60
    df = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.component_id for r in shingle_components(df).collect()}
    missed = [(a, b) for a, b in pairs if got[rows[a][0]] != got[rows[b][0]]]
    assert missed == []
    assert got == {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}
    kept = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_one_group_with_a_base_and_edge_cases(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for k in rng.sample(range(300), 6):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(500, "Short one"), (501, "short  ONE"), (502, "short two"), (None, "alone"), (None, "short two"), (502, "short two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    label, pairs = brute([t for _, t in rows])
    assert len(pairs) < 400 * 399 / 2  # not all pairs of the group are linked themselves
    got = shingle_components(df).where("doc_id is not null").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, rows[label[k]][0]) for k, (i, _) in enumerate(rows) if i is not None}
    assert sorted((r.doc_id for r in drop_near_copies(df).collect()), key=str) == [0, 500, 502, None, None]
    assert drop_near_copies(df.limit(0)).collect() == []


def test_large_buckets_are_banded_again_and_compared_in_blocks(spark, monkeypatch):
    """A cloud of texts around the threshold, whose buckets stay mixed, under tiny buckets and one level."""
    monkeypatch.setattr(shingle_copies, "MAX_BUCKET", 4)
    monkeypatch.setattr(shingle_copies, "LEVELS", 1)
    rng = random.Random(8)
    rows = []
    for i in range(90):
        words = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(200), 2 + 2 * (i % 2)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    label, pairs = brute([t for _, t in rows])
    assert 50 < len(pairs) < 3900 and len(set(label)) > 1
    got = {r.doc_id: r.component_id for r in shingle_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}


def test_rows_with_one_id_and_different_texts_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (6, texts[2]), (6, texts[2]), (7, texts[1])], "doc_id bigint, text string")
    for drop in (drop_near_copies, drop_near_duplicates):
        assert sorted((r.doc_id, r.text) for r in drop(df).collect()) == [(5, texts[0]), (5, texts[1]), (6, texts[2])]
