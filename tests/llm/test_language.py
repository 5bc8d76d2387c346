"""Language mixtures on made-up languages: held-out accuracy, mixtures, and edge cases."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm.language_mixture import BUCKETS, MixtureModel, _trigrams, held_out, learn, mixtures, proportions, with_language

SYLLABLES = {"aa": "ba be bi bo bu na ne".split(), "bb": "ské tro čra vy ně hr".split(), "cc": "дом лес ква сто на".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(1)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES))), lang) for i in range(400)]


def test_learning_counts_everything(spark):
    data = rows()
    model = learn(spark.createDataFrame(data + [(1, None, "aa"), (2, "zz", None)], "doc_id bigint, text string, lang string"))
    assert model.languages == ("aa", "bb", "cc")
    n = np.zeros((BUCKETS, 3))
    for k, lang in enumerate(model.languages):
        bucket, _, _ = _trigrams([t for _, t, x in data if x == lang])
        n[:, k] = np.bincount(bucket, minlength=BUCKETS)
    want = np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * BUCKETS)
    assert np.allclose(model.log_p, want, atol=1e-5)
    empty = learn(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert empty.languages == () and proportions(["abc"], empty).shape == (1, 0)


def test_prediction(spark):
    data, rng = rows(), random.Random(9)
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = learn(df.where(~held_out()))
    mixed = text(rng, "aa", 70) + "\n" + text(rng, "cc", 30)
    odd = [(1000, None, "q"), (1001, "", "q"), (1002, "12 !? 34", "q"), (1003, mixed, "q"), (None, text(rng, "bb"), "q"), (1004, "ba " * 200_000, "q"), (1003, mixed, "q")]
    asked = df.unionByName(spark.createDataFrame(odd, df.schema)).withColumn("score", F.lit("clash"))
    got = with_language(asked, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "mixture"]
    found = got.collect()
    assert len(found) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) == 1
    by = {r.doc_id: r for r in found}
    for i in (1000, 1001, 1002):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].mixture == {}
    assert set(by[1003].mixture) == {"aa", "cc"} and by[1003].lang_pred == "aa" and abs(by[1003].mixture["aa"] - 0.7) < 0.05
    assert by[None].lang_pred == "bb" and by[1004].lang_pred == "aa"
    assert with_language(asked.limit(0), model).collect() == []


def test_ties_and_no_model(spark):
    model = MixtureModel(("x", "y"), np.zeros((BUCKETS, 2), np.float32))
    assert proportions(["abc"], model).argmax() == 0
    none = MixtureModel((), np.zeros((BUCKETS, 0), np.float32))
    df = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert with_language(df, none).first().lang_pred == "und"


def test_mixtures_against_all_sets_of_languages(spark):
    """EM by plain loops until nothing moves, and the least penalised likelihood of every set of languages."""
    model, rng = learn(spark.createDataFrame(rows(), "doc_id bigint, text string, lang string")), random.Random(5)
    texts = [" ".join(text(rng, lang, n) for lang, n in zip(SYLLABLES, [rng.choice((0, 0, 3, 8, 20, 60)) for _ in range(3)])) + " ba" for _ in range(40)]
    got, whole = mixtures(texts, model)
    for t, row, all_ in zip(texts, got, whole):
        words = []
        for w in t.split():
            bucket, _, _ = _trigrams([w])
            words.append(model.log_p[bucket].astype(float).sum(0))
        p = np.array(words)
        p = np.exp(np.maximum(p - p.max(1, keepdims=True), -60))
        found = {}
        for m in (1, 2, 3):
            for chosen in itertools.combinations(range(3), m):
                pi = np.array([1 / m if k in chosen else 0.0 for k in range(3)])
                for _ in range(3000):
                    pi = (p * pi / (p * pi).sum(1, keepdims=True)).mean(0)
                found[chosen] = (-2 * np.log((p * pi).sum(1)).sum() + m * np.log(max(2, len(p))), pi)
        best = min(found, key=lambda c: found[c][0])
        assert set(np.flatnonzero(row).tolist()) == set(best) and np.abs(row - found[best][1]).max() < 0.01
        assert np.abs(all_ - found[0, 1, 2][1]).max() < 0.01
