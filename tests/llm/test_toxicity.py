"""Toxicity by compression distance: held-out accuracy, and edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge.llm.toxicity import WINDOW_WORDS, learn_toxicity, windows, with_toxicity

LARGE = "/root/testdata/sf0.1"


def test_windows_hold_every_word():
    for n in (0, 1, 2, 7, 8, 9, 15, 16, 50):
        words = [f"W{i}" for i in range(n)]
        found = windows(" ".join(words))
        assert [w.split() for w in found] == [[x.lower().encode() for x in words[i : i + WINDOW_WORDS]] for i in range(0, max(n - 1, min(n, 1)), WINDOW_WORDS - 1)]
        assert {x for w in found for x in w.split()} == {x.lower().encode() for x in words}
    assert windows(None) == windows(" \n") == []


def generated(rng, i, toxic):
    words = ["".join(rng.choice(("ba", "no", "ri", "tel", "um", "ska", "e", "pli")) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 200))]
    if toxic:
        for _ in range(rng.randrange(2, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(("grumblewort", "Snotface", "fizzbrain")))
    return (i, " ".join(words), int(toxic))


def test_learns_and_scores(spark):
    rng = random.Random(4)
    rows = [generated(rng, i, i % 5 == 0) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id int, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 900] + [(None, 1), (3, None), (99999, 1)], "doc_id int, toxic int")
    model = learn_toxicity(docs, labels)
    odd = spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, " \t", ""), (-4, rows[1][1] + " fizzbrain snotface grumblewort", ""), (-5, rows[1][1] * 300, ""), (0, rows[0][1], ""), (0, rows[0][1], "")], docs.schema)
    got = with_toxicity(docs.unionByName(odd), model)
    assert got.columns == ["doc_id", "text", "score"]
    found = {}
    for r in got.collect():
        assert found.setdefault((r.doc_id, r.text), r.score) == r.score and 0 <= r.score <= 1
    held = [(found[i, t], y) for i, t, y in rows if i >= 900]
    assert sum((s >= 0.3) == y for s, y in held) >= 0.97 * len(held)
    assert found[-1, None] == found[-2, ""] == found[-3, " \t"] < 0.3 < found[-4, odd.collect()[3].text] and found[-5, rows[1][1] * 300] < 0.5
    assert with_toxicity(docs.limit(0), model).collect() == []


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    for labels, score in (([], 0.5), ([(1, 1)], 2 / 3), ([(1, 0), (1, 0)], 1 / 3)):
        model = learn_toxicity(docs, spark.createDataFrame(labels, "doc_id int, toxic int"))
        assert all(abs(r.score - score) < 1e-9 for r in with_toxicity(docs, model).collect())


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the given tables")
def test_held_out_rows_of_the_given_table(spark):
    from spanforge.llm.queries import op13_compression_toxicity

    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic")
    held = op13_compression_toxicity(spark, LARGE).where("held_out").join(labels, "doc_id")
    tp, fp, fn = held.agg(F.sum(F.col("toxic") * F.col("predicted")), F.sum((1 - F.col("toxic")) * F.col("predicted")), F.sum(F.col("toxic") * (1 - F.col("predicted")))).first()
    assert 2 * tp / (2 * tp + fp + fn) >= 0.8
