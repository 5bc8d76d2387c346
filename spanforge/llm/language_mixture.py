"""Language proportions of each document by expectation-maximisation over words.

A model holds, for each language, the log probabilities of hashed letter
trigrams. A document is a bag of words, each written in one language; the
likelihood of a word is that of its trigrams. EM estimates the proportions of
the languages, and the set of languages is that of least penalised likelihood
(BIC): -2 log L + |set| log(words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import pieces, slices, unused

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: EM ends for a document when no proportion moves by TOLERANCE; MOST_ROUNDS is out of its reach in practice.
TOLERANCE = 1e-4
MOST_ROUNDS = 1000
#: More languages than these would make the model (BUCKETS numbers each) too large to send to every task: an error.
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
SLICE_BYTES = 1 << 19


@dataclass(frozen=True)
class MixtureModel:
    """Languages in order, and log probabilities (BUCKETS x languages)."""

    languages: tuple[str, ...]
    log_p: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of the texts in order: the bucket of its trigram, the number of its document; where words start.

    A trigram is a letter with its neighbours, lower-cased; what is no letter is a space.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(32))
    at = np.flatnonzero(letter)
    mixed = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ (c[at + 1] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
    bucket = (mixed * np.uint32(0x2545F491)) >> np.uint32(32 - BUCKET_BITS)
    ends = np.cumsum([len(t) + 1 for t in lowered]) + 1
    doc = np.searchsorted(ends, at, "right")
    starts = np.flatnonzero(~letter[at - 1])
    return bucket.astype(np.int64), doc, starts


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """Count the trigrams of every row with a language and a text; no sampling.

    The driver gets a count for each language and bucket, at most
    BUCKETS x languages numbers whatever the input. Without such rows the model
    has no language.
    """

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", SLICE_BYTES):
            langs = np.array(part.column("lang").to_pylist(), object)
            bucket, doc, _ = _trigrams(part.column("text").to_pylist())
            names, which = np.unique(langs.astype(str), return_inverse=True)
            counts = np.bincount(which[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names.tolist(), counts):
                totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages")
    n = np.zeros((BUCKETS, len(names)))
    lang = np.searchsorted(names, counted.column("lang").to_pylist()) if names else np.empty(0, int)
    n[counted.column("bucket").to_numpy(), lang] = counted.column("n").to_numpy()
    log_p = np.log(n + SMOOTHING) - np.log(n.sum(0) + SMOOTHING * BUCKETS)
    return MixtureModel(tuple(names), log_p.astype(np.float32))


def _mixtures(p: np.ndarray, pi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """EM from the proportions pi (documents x languages) over word likelihoods p (words x languages), n words a document.

    Each document goes on until its own proportions stand still.
    """
    out, left = pi.copy(), np.arange(len(pi))
    for _ in range(MOST_ROUNDS):
        first = np.cumsum(n) - n
        r = p * np.repeat(pi, n, axis=0)
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, first, axis=0) / n[:, None]
        moves = np.abs(new - pi).max(1) >= TOLERANCE
        out[left] = new
        if not moves.any():
            break
        if not moves.all():
            p = p[np.repeat(moves, n)]
        left, n, pi = left[moves], n[moves], new[moves]
    return out


def _log_likelihood(p: np.ndarray, pi: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log((p * pi[doc]).sum(1)), first)


def proportions(texts: list[str | None], model: MixtureModel) -> np.ndarray:
    """documents x languages: the proportions within the chosen set; zeros for a text without letters."""
    return mixtures(texts, model)[0]


def mixtures(texts: list[str | None], model: MixtureModel) -> tuple[np.ndarray, np.ndarray]:
    """documents x languages: the proportions within the chosen set, and those over all languages; zeros for a text without letters."""
    out, whole = np.zeros((2, len(texts), len(model.languages)))
    bucket, letter_doc, starts = _trigrams(texts)
    if not len(starts) or not model.languages:
        return out, whole
    log_p = np.add.reduceat(model.log_p[bucket], starts, axis=0).astype(np.float64)
    p = np.exp(np.maximum(log_p - log_p.max(1, keepdims=True), -60))
    present, first, n = np.unique(letter_doc[starts], return_index=True, return_counts=True)
    doc = np.repeat(np.arange(len(present)), n)
    k = p.shape[1]
    pi = _mixtures(p, np.full((len(present), k), 1 / k), n)
    order = np.argsort(-pi, axis=1, kind="stable")
    every = np.arange(len(present))
    best = np.zeros_like(pi)
    best[every, order[:, 0]] = 1
    penalty = np.log(np.maximum(n, 2))
    bic = -2 * np.add.reduceat(np.log(p[np.arange(len(p)), order[doc, 0]]), first) + penalty
    # No larger set can win where even the likelihood of all languages doesn't pay for a second one.
    open_ = np.flatnonzero(-2 * _log_likelihood(p, pi, doc, first) + 2 * penalty < bic)
    for m in range(2, k + 1):
        if not len(open_):
            break
        words = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in open_])
        own, begin = np.repeat(np.arange(len(open_)), n[open_]), np.r_[0, np.cumsum(n[open_])[:-1]]
        some = np.where(np.argsort(order[open_], axis=1) < m, np.maximum(pi[open_], 1e-6), 0)
        some = _mixtures(p[words], some / some.sum(1, keepdims=True), n[open_])
        value = -2 * _log_likelihood(p[words], some, own, begin) + m * penalty[open_]
        better = value < bic[open_]
        best[open_[better]], bic[open_[better]] = some[better], value[better]
    out[present], whole[present] = best, pi
    return out, whole


def with_language(docs: DataFrame, model: MixtureModel, *, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and mixture to every row; they replace columns of these names.

    ``mixture`` maps the chosen languages to their proportions; ``lang_pred`` is
    that of the largest (ties: the first by name), and ``score`` its proportion in
    the mixture of all languages, before the set was chosen: below 1 where other
    languages explain some words as well.
    A null text, one without letters, or any text under a model without
    languages is ``und`` with score 0 and an empty mixture. The whole text is
    read and nothing but the text counts. Memory: a slice of about half a MB of text
    or one document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang_pred:string,score:double,mixture:map<string,double>>"
    to = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])

    @F.arrow_udf(kind)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value.languages
        for part in pieces(texts, SLICE_BYTES):
            rows = []
            for row, all_ in zip(*mixtures(part.to_pylist(), shared.value)):
                used = np.flatnonzero(row).tolist()
                best = int(row.argmax()) if used else 0
                rows.append({"lang_pred": names[best] if used else UNDETERMINED, "score": min(1.0, float(all_[best])) if used else 0.0, "mixture": [(names[j], float(row[j])) for j in used]})
            yield pa.array(rows, to)

    # Called once a row: Spark doesn't copy what it takes for nondeterministic into filters and projections.
    (language,) = unused(docs.columns, "language")
    found = docs.withColumn(language, predict.asNondeterministic()(F.col(f"`{text_col}`")))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "mixture")]
    return found.select(*names, *[F.col(language)[c].alias(c) for c in ("lang_pred", "score", "mixture")])


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
