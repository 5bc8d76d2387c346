"""Periodic runs against all periods of all stretches."""

import random

from spanforge.llm.periodic_runs import document_runs, runs_of, with_runs


def brute(words, min_words=6, min_periods=4):
    """Every period on its own; a run with a smaller period of the same words is none."""
    n, found = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_periods * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def sequences(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(60))]
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.randrange(rng.choice((2, 5, 50))) for _ in range(rng.choice((1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 33)))]
        times = rng.randrange(1, 8)
        out += (unit * times)[: rng.randrange(1, len(unit) * times + 1)]
        out += [rng.randrange(50) for _ in range(rng.randrange(5))]
    if kind == 3:  # runs of runs
        out = (out[:20] * 5)[: rng.randrange(5, 100)]
    return out


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        words = sequences(rng)
        assert runs_of(words) == brute(words), words
        assert runs_of(words, 1, 3) == brute(words, 1, 3), words


def test_stretches_lose_no_run():
    rng = random.Random(6)
    for limits in ((6, 4), (1, 3), (20, 3), (9, 5)):
        many = [sequences(rng) for _ in range(600)]
        texts = [" ".join(map(str, w)).encode() for w in many]
        _, runs = document_runs(texts, *limits)
        for words, got in zip(many, runs):
            assert got == brute(words, *limits), (words, limits)


def test_long_repeats_stay_fast():
    assert runs_of([7] * 200_000) == [(0, 200_000, 1)]
    unit = list(range(30_000))
    assert runs_of(unit * 5 + [1]) == [(0, 150_000, 30_000)]
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert runs_of(b) == []  # Fibonacci words have no fourth power


def test_whole_rows(spark):
    rows = [(1, "a b a b a b a b x"), (1, "a b a b a b a b x"), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 6), (None, "x x x x x"), (6, "é é " * 5 + "\x0bend"), (7, "w " * 300_000)]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id int, text string, found int, runs string")
    got = with_runs(df)
    assert got.columns == ["doc_id", "text", "found", "runs", "collapsed"]
    out = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == len(rows)
    assert out[1, rows[0][1]] == ([(0, 8, 2)], "a b x")
    assert out[2, None] == out[3, ""] == out[4, " \t\n"] == ([], "")
    assert out[5, "x " * 6] == ([(0, 6, 1)], "x")
    assert out[None, "x x x x x"] == ([], "x x x x x")
    assert out[6, rows[7][1]] == ([], ("é é " * 5).strip() + " end")
    assert out[7, rows[8][1]] == ([(0, 300_000, 1)], "w")
    assert with_runs(df.limit(0)).collect() == []
