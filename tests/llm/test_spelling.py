"""Near words and their forms against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import spelling
from spanforge.llm.spelling import build_tree, count_words, home_leaves, leaves_in_reach, letter_counts, letter_runs, spelling_variants, word_matrix


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n and counts[best] > n else None
        out[w] = [form[w], None, n, len(others), counts[form[w]] if form[w] else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(rng, size, letters="abcdé"):
    counts = Counter()
    while len(counts) < size:
        word = "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 5, 6, 6, 7, 8))))
        counts[word] = int(5 ** rng.uniform(0, 5))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", *letters]) + word[at + rng.randrange(2) :]
            if word:
                counts[word] = int(5 ** rng.uniform(0, 5))
    return counts


def test_boxes_lose_no_near_word():
    rng = random.Random(3)
    words = [w for w in vocabulary(rng, 3000) if len(w) == 6]
    counts = letter_counts(word_matrix(words))
    tree = build_tree(counts, 8)
    home = home_leaves(tree, counts)
    assert sorted(np.concatenate(tree.members)) == list(range(len(words))) and all((home[m] == k).all() for k, m in enumerate(tree.members))
    for longer in (-1, 0, 1):
        asked = [w for w in vocabulary(rng, 800) if len(w) == 6 - longer]
        reached = {(leaf, i) for leaf, rows in leaves_in_reach(tree, letter_counts(word_matrix(asked)), longer) for i in rows.tolist()}
        assert all((home[j], i) in reached for i, a in enumerate(asked) for j, w in enumerate(words) if near(a, w))
        assert len(reached) < len(asked) * len(tree.members)


@pytest.mark.parametrize("cell, sample", [(16_384, 65_536), (40, 65_536), (40, 300)])
def test_against_all_pairs(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", sample)
    counts = vocabulary(random.Random(cell + sample), 1200)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert found == brute(counts)


def test_odd_rows(spark):
    long = "x" * 70_000
    rows = [("colour", 3, 1), ("colour", 2, 2), ("color", 1, 3), (None, 5, 4), ("", 5, 5), ("Ünit", None, 6), ("ünit", 4, 7), (long, 1, 8), (long + "y", 9, 9)]
    df = spark.createDataFrame(rows, "word string, n bigint, size int")
    out = {r.word: tuple(r)[1:] for r in spelling_variants(df).collect()}
    assert out == brute({"colour": 5, "color": 1, "Ünit": 0, "ünit": 4, long: 1, long + "y": 9})
    assert spelling_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, ratio=1)


def test_runs_of_letters(spark):
    df = spark.createDataFrame([("Ab1cÉÀ×d-e ŒX",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(letter_runs(df.text)).collect()] == [["ab", "cÉÀ×d", "e", "x"], [], []]
    assert {tuple(r) for r in count_words(df, letter_runs(df.text), least_length=1, least=1).collect()} == {("ab", 1), ("cÉÀ×d", 1), ("e", 1), ("x", 1)}
