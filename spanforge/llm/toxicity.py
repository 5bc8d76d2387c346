"""Toxicity by compression distance: windows of words are compressed with zstandard under two dictionaries.

Both dictionaries hold the same base, trained on ordinary text, so that ordinary
windows come out alike. Before it stands what was trained on the words that set
toxic text apart from ordinary text in the one, and ordinary from toxic text in the other. The bytes that
a window saves under the toxic dictionary are its distance; a document's
distances give six numbers, which a logistic model, fitted on rows that the
dictionaries haven't seen, turns into a score. Which words set the two apart is decided by the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, materialize, slices

#: The fit takes about so many labelled rows (by hash), of which TRAINED in ten train dictionaries and the others calibrate.
FIT_ROWS = 50_000
TRAINED = 6
#: Windows of ordinary text that the base is trained on, and the characteristic words of each side, at most.
BASE_WINDOWS = 20_000
MOST_WORDS = 5_000
BASE_BYTES = 16 << 10
SIDE_BYTES = 4 << 10
#: A word counts so often in a dictionary's training at most.
WORD_WEIGHT = 100
LEAST_CONTEXTS = 3
#: What is tried for characteristic words: least log-likelihood ratio, and so many times the other side's share.
TRIED = ((12.0, 4.0), (12.0, 12.0), (24.0, 6.0), (24.0, 12.0), (48.0, 12.0), (96.0, 12.0))

#: A window has so many words, the last of which begins the next.
WINDOW_WORDS = 8
LEVEL = 12
SAVED_BYTES = 3
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries, and the logistic model over a document's features. Without dictionaries a constant."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept


@lru_cache(8)
def _compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of a text's words in lower case; every word is in one."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    step = WINDOW_WORDS - 1
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, max(len(words) - 1, min(len(words), 1)), step)]


def features(text: str | None, toxic: bytes, ordinary: bytes) -> list[float]:
    """Of the bytes saved a window: most, mean of the three largest, mean; windows that save SAVED_BYTES (log), their share; windows (log)."""
    a, b = _compressor(ordinary).compress, _compressor(toxic).compress
    saved = np.array([len(a(w)) - len(b(w)) for w in windows(text)], float)
    if not len(saved):
        return [0.0] * 6
    n = int((saved >= SAVED_BYTES).sum())
    return [saved.max(), np.sort(saved)[-3:].mean(), saved.mean(), np.log1p(n), n / len(saved), np.log1p(len(saved))]


def _scores(rows: np.ndarray, model: ToxicityModel) -> np.ndarray:
    z = (rows - np.array(model.mean)) / np.array(model.scale)
    z = z @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, mean log loss) by Newton's method with a ridge of one."""
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-9)
    x = np.c_[(rows - mean) / scale, np.ones(len(rows))]
    ridge = np.diag([1.0] * rows.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        size = np.abs(step).max()
        w = w - step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return mean, scale, w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard trains on the samples; from too few for that, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _log_likelihood(k1: Column, n1: int, k2: Column, n2: int) -> Column:
    """Of a word in k1 of n1 contexts against k2 of n2; 0 if the first share isn't larger."""

    def part(k, n, p):
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    return F.when(p1 > p2, 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))).otherwise(0.0)


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit the dictionaries and the score on about ``fit_rows`` labelled rows, chosen by a hash of their id.

    A document without a label, a null label and a null id aren't learnt from; a document with
    several labels counts with each. Only the chosen labels are sent to all
    tasks, so that texts aren't shuffled. Rows of equal text are one, and on one side
    of the split between training and calibration. The driver gets characteristic words,
    sampled windows and six numbers a calibration row, all bounded.
    Without both kinds of labels on both sides the model is a constant.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") > 0).cast("int").alias("toxic")).dropna()
    share = min(1.0, fit_rows / max(known.count(), 1))
    chosen = known.where(F.xxhash64(F.lit("fit"), "id") / F.lit(2.0**64) + 0.5 < share)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    unlike = texts.join(F.broadcast(chosen), "id").dropDuplicates(["text", "toxic"]).select("text", "toxic")
    rows = materialize(unlike.withColumn("trains", F.pmod(F.xxhash64(F.lit("side"), "text"), F.lit(10)) < TRAINED), "labelled")
    sizes = {(r["trains"], r["toxic"]): r["n"] for r in rows.groupBy("trains", "toxic").agg(F.count("*").alias("n")).collect()}
    prior = (1 + sum(n for (_, t), n in sizes.items() if t)) / (2 + sum(sizes.values()))
    if len(sizes) < 4:
        discard(rows)
        return ToxicityModel(b"", b"", (0.0,) * 6, (1.0,) * 6, (0.0,) * 6 + (float(np.log(prior / (1 - prior))),))
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = rows.where("trains").select("toxic", words.alias("words")).select("toxic", F.explode(F.arrays_zip("words", F.concat(F.array(F.lit("")), "words").alias("before"))).alias("w"))
    # Near copies of a passage show a word behind one and the same word: that counts once.
    behind = words.where("w.words is not null").groupBy(F.col("w.words").alias("word"), F.col("w.before").alias("before")).agg(F.max("toxic").alias("k1"), F.max(1 - F.col("toxic")).alias("k2"))
    counted = materialize(behind.groupBy("word").agg(F.sum("k1").alias("k1"), F.sum("k2").alias("k2")), "counted-words")
    n1, n2 = (max(n or 0, 1) for n in counted.agg(F.sum("k1"), F.sum("k2")).first())
    of_toxic, of_ordinary = _log_likelihood(F.col("k1"), n1, F.col("k2"), n2), _log_likelihood(F.col("k2"), n2, F.col("k1"), n1)
    times = (F.col("k1") / n1) / ((F.col("k2") + 1) / n2), (F.col("k2") / n2) / ((F.col("k1") + 1) / n1)
    sides = {"toxic": ("k1", of_toxic, times[0]), "ordinary": ("k2", of_ordinary, times[1])}
    most = {}
    for name, (n, likelihood, share) in sides.items():
        marked = counted.select("word", F.col(n).alias("n"), likelihood.alias("likelihood"), share.alias("times"))
        marked = marked.where((F.col("n") >= LEAST_CONTEXTS) & (F.col("likelihood") >= min(a for a, _ in TRIED)) & (F.col("times") >= min(b for _, b in TRIED)))
        most[name] = [tuple(r) for r in marked.orderBy(F.desc("likelihood"), "word").limit(MOST_WORDS).collect()]

    def sampled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in batch.column("text").to_pylist() for w in windows(t)], pa.binary())], ["w"])

    every = rows.where("trains and toxic = 0").select("text").mapInArrow(sampled, "w binary")
    keep = min(1.0, BASE_WINDOWS / max(every.count(), 1))
    base = _trained(sorted({bytes(r["w"]) for r in every.where(F.xxhash64("w") / F.lit(2.0**64) + 0.5 < keep).collect()}), BASE_BYTES)

    def side(name: str, likelihood: float, times: float) -> bytes:
        # In rounds, so that each part of the samples that zstandard picks from has all words.
        chosen = [(b" " + w.encode("utf-8", "surrogatepass") + b" ", n) for w, n, a, b in most[name] if a >= likelihood and b >= times]
        return _trained([w for k in range(WORD_WEIGHT) for w, n in chosen if k < n], SIDE_BYTES)

    contents = [(side("toxic", *limits) + base, side("ordinary", *limits) + base) for limits in TRIED]

    def measured(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").to_pylist()
            found = [[x for toxic, ordinary in contents for x in features(t, toxic, ordinary)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    table = rows.where("not trains").select("text", "toxic").mapInArrow(measured, "toxic int, x array<double>").toArrow()
    y = table.column("toxic").to_numpy().astype(float)
    x = np.array(table.column("x").to_pylist()).reshape(len(y), len(TRIED), 6)
    fits = [_logistic(x[:, k], y) for k in range(len(TRIED))]
    best = min(range(len(TRIED)), key=lambda k: fits[k][3])
    discard(rows, counted)
    mean, scale, weights, _ = fits[best]
    return ToxicityModel(*contents[best], tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every row; a column of that name is replaced.

    A text is read whole, in windows. A null text is an empty one; it has no
    windows and the score of that. A text of one short word saves nothing, as zstandard leaves so few bytes as they are. Repeated rows have equal scores, other columns
    stay as they are and count for nothing. Nothing is shuffled; the model, some 40 KB, goes to
    all tasks.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            out = []
            for part in slices([pa.RecordBatch.from_arrays([array], ["text"])], "text", SLICE_BYTES):
                rows = np.zeros((len(part), 6))
                if model.toxic:
                    rows = np.array([features(t, model.toxic, model.ordinary) for t in part.column("text").to_pylist()])
                out.append(_scores(rows, model))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c != as_col]
    return docs.select(*kept, score.asNondeterministic()(F.col(f"`{text_col}`")).alias(as_col))
