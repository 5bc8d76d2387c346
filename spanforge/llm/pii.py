"""Information-theoretic sanitisation of personal data.

Addresses, cards and phone numbers are found by fixed patterns: the protected
entities. Every word is then weighed by what it reveals of them, over the whole
corpus: with P(e) the share of documents that hold entity e and P(e|t) the
share, among the documents with term t, of those that hold e too,

    disclosure = PMI(e; t) / IC(e) = 1 + log2 P(e|t) / -log2 P(e)

P(e|t) is smoothed towards P(e) by ``PRIOR`` documents, so that one document
counts too, and more of them count for more; then the disclosure is near 1 if t
gives e away and 0 if it says nothing. Every occurrence of a term beyond the
threshold is marked, in documents that don't hold the entity too: generalised,
or removed where it gives the entity away.

Entities that are in the same documents reveal the same and are one group, so
that a document with many entities of its own isn't paired with its words once
for each. Words that can't reach the threshold, as too many documents hold
them, are left out before pairs are made.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import discard, join_hot, materialize, release, slices

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD = 0.95
REMOVE_FROM = 0.999
PRIOR = 0.01
FLUSH_TERMS = 300_000
SLICE_BYTES = 1 << 20
PART_ROWS = 256
#: A text that is sent to all tasks, as very many rows have it, is smaller than this.
MOST_BROADCAST = 1 << 15
#: Letters of a term; a longer run of letters is no word.
LONGEST_TERM = 64
#: Bits for each term of the filter that scans are given (so many that hardly a text of thousands of words passes by
#: chance), and the most bits of a filter. With more terms than half fill that there is no filter: everything goes
#: through, and joins decide.
TERM_BITS = 1024
MOST_BITS = 1 << 27
FILTER_HASHES = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """From each @ to the left: what a scan from the left would find, without trying every start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start: leftmost matches that don't overlap within a kind; failing ones are dropped."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _digest(value: str) -> bytes:
    return xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass"))


def _entity(kind: int, value: str) -> bytes:
    return _digest(f"{kind}:{value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}")


def terms_of(text: str) -> set[str]:
    return {t for t in map(str.lower, set(_TERM.findall(text))) if len(t) <= LONGEST_TERM}


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


_HITS = pa.list_(pa.struct([("term", pa.binary()), ("spots", pa.list_(_SPAN))]))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text_sha256, base, entities, terms, text) for every row; terms and the text only where there is an entity."""

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("id", "text_a", "text_b", "text_sha256")),
                    pa.array([[dict(zip(("kind", "start", "stop"), x)) for x in s] for s in spans], pa.list_(_SPAN)),
                    pa.array([list({_entity(k, t[a:b]) for k, a, b in s}) for t, s in zip(texts, spans)], pa.list_(pa.binary())),
                    pa.array([[_digest(w) for w in terms_of(t)] if s else [] for t, s in zip(texts, spans)], pa.list_(pa.binary())),
                    pa.array([t if s else None for t, s in zip(texts, spans)], pa.string()),
                ],
                ["id", "text_a", "text_b", "text_sha256", "base", "entities", "terms", "text"],
            )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_text_key(text), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_a bigint, text_b bigint, text_sha256 string, base array<struct<kind:int,start:int,stop:int>>, entities array<binary>, terms array<binary>, text string"
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("text"), text).alias("text_b")


# ---------------------------------------------------------------- filters of terms


def _bits(digests: list[bytes], size: int) -> np.ndarray:
    """FILTER_HASHES places in a filter of ``size`` bits for each digest."""
    h = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    k = np.arange(FILTER_HASHES, dtype=np.uint64)
    return ((h[:, :1] + k * h[:, 1:]) % np.uint64(size)).astype(np.int64)


def _term_filter(terms: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the terms, made in parts and united by Spark; None for more terms than fit one."""
    n = terms.count()
    size = max(64, min(1 << (n * TERM_BITS - 1).bit_length(), MOST_BITS)) if n else 64
    if n * FILTER_HASHES > size * np.log(2):
        return None

    def run(batches):
        words = np.zeros(size // 64, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at = _bits(batch.column("term").to_pylist(), size).ravel()
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(words[used].view(np.int64), pa.int64())], ["word", "bits"])

    united = terms.select("term").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[united.column("word").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray | None, digests: list[bytes]) -> np.ndarray:
    if words is None:
        return np.ones(len(digests), bool)
    at = _bits(digests, len(words) * 64)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def _term_documents(docs: DataFrame, text_col: str, wanted: np.ndarray | None) -> DataFrame:
    """(term, n): how many documents hold each term that passes the filter, as counts of parts of the input."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        counts: dict[str, int] = {}

        def flush():
            digests = [_digest(t) for t in counts]
            kept = np.flatnonzero(_passes(shared.value, digests))
            n = np.fromiter(counts.values(), np.int64, len(counts))[kept]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([digests[k] for k in kept], pa.binary()), pa.array(n)], ["term", "n"])

        for part in slices(batches, "text", SLICE_BYTES):
            for text in part.column("text").to_pylist():
                for term in terms_of(text):
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) > FLUSH_TERMS:
                    yield flush()
        if counts:
            yield flush()
        release()

    return docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null").mapInArrow(run, "term binary, n bigint")


def _elsewhere(docs: DataFrame, text_col: str, wanted: np.ndarray | None) -> DataFrame:
    """(row, text_a, text_b, text, hits) of texts that hold terms that pass the filter, a row a text: hits are the terms with their spots."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["text_a", "text_b", "text", "hits"]

    def run(batches):
        known: dict[str, bytes | None] = {}  # the digests of terms that pass
        for part in slices(batches, "text", SLICE_BYTES):
            if len(known) > FLUSH_TERMS:
                known.clear()
            kept, hits = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                terms = terms_of(text)
                new = [t for t in terms if t not in known]
                if new:
                    digests = [_digest(t) for t in new]
                    known.update(zip(new, (d if ok else None for d, ok in zip(digests, _passes(shared.value, digests)))))
                if found := {t: [] for t in terms if known[t]}:
                    for m in _TERM.finditer(text):
                        if (spots := found.get(m[0].lower())) is not None:
                            spots.append({"kind": 4, "start": m.start(), "stop": m.end()})
                    kept.append(k)
                    hits.append(pa.array([[{"term": known[t], "spots": spots} for t, spots in found.items()]], _HITS))
            if kept:
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names[:3]), pa.concat_arrays(hits)], names)
        release()

    text = F.col(f"`{text_col}`")
    rows = docs.where(text.isNotNull()).select(*_text_key(text), text.alias("text"))
    found = rows.mapInArrow(run, "text_a bigint, text_b bigint, text string, hits array<struct<term: binary, spots: array<struct<kind: int, start: int, stop: int>>>>")
    return found.withColumn("row", F.monotonically_increasing_id())


# ---------------------------------------------------------------- disclosure


def _entity_groups(found: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(row, group, n_entity): entities by the documents that hold them; a group has equal documents, n_entity of them. And the tables that it reads."""
    held = materialize(found.select("row", F.explode("entities").alias("entity")), "pii-entities")
    groups = held.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit("row"), "row").cast("decimal(38,0)")).alias("y"))
    groups = materialize(groups.select("entity", "n", F.struct("x", F.xxhash64("y", "n").alias("y")).alias("group")), "pii-groups")
    return join_hot(held, groups, "entity").select("row", "group", F.col("n").alias("n_entity")).distinct(), (held, groups)


def disclosing_terms(found: DataFrame, docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(revealing, row_terms): terms beyond the threshold with the largest disclosure of any entity, and the terms of rows with entities.

    revealing: term, disclosure, n_in (documents with entities that hold it),
    n_term (all documents that do). row_terms: row, term.
    """
    n_docs = max(found.count(), 1)
    row_terms = materialize(found.select("row", F.explode("terms").alias("term")), "pii-terms")
    inside = row_terms.groupBy("term").agg(F.count("*").alias("n_in"))
    # What isn't in a document with entities reveals none: only terms that are need counting.
    counted = _term_documents(docs, text_col, _term_filter(inside)).groupBy("term").agg(F.sum("n").alias("n_term"))
    counted = materialize(inside.join(counted, "term"), "pii-counts")
    groups, used = _entity_groups(found)
    groups = materialize(groups, "pii-rows")
    most = groups.groupBy("row").agg(F.max("n_entity").alias("most"), F.min("n_entity").alias("least"))
    share = lambda n: n / F.lit(float(n_docs))
    reaches = (F.col("most") + prior) / (F.col("n_term") + prior) >= F.pow(share(F.col("most")), F.lit(1 - threshold)) * (1 - 1e-9)
    rare = join_hot(row_terms, counted, "term", n_col="n_in").join(most, "row").where(reaches).select("row", "term", "n_in", "n_term", "most", "least")
    rare = materialize(rare, "pii-rare")
    # An entity of one document is in one with each of its terms: nothing to count. Others are counted with their groups.
    single = rare.where("least = 1").select("term", "n_in", "n_term", F.lit(1).cast("long").alias("n_entity"), F.lit(1).cast("long").alias("both")).distinct()
    several = rare.where("most > 1").join(groups.where("n_entity > 1"), "row")
    several = several.groupBy("group", "n_entity", "term", "n_in", "n_term").agg(F.count("*").alias("both")).select("term", "n_in", "n_term", "n_entity", "both")
    e = share(F.col("n_entity"))
    content = -F.log2(e)
    given = (F.col("both") + prior * e) / (F.col("n_term") + prior)
    weighed = single.unionByName(several).withColumn("disclosure", F.when(content > 0, 1 + F.log2(given) / content).otherwise(0.0)).where(F.col("disclosure") >= threshold)
    revealing = materialize(weighed.groupBy("term", "n_in", "n_term").agg(F.max("disclosure").alias("disclosure")), "pii-revealing")
    discard(counted, groups, rare, *used)
    return revealing, row_terms


_MARK = "array<struct<kind:int,start:int,stop:int,disclosure:double>>"
_MARKED = pa.struct([*_SPAN, pa.field("disclosure", pa.float64())])


def _in_parts(function, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """A function of arrays, for ``PART_ROWS`` rows at a time: its Python objects take many times the arrays' room."""
    parts = [function(*(c.slice(a, PART_ROWS) for c in columns)) for a in range(0, len(columns[0]), PART_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _marks(text: Column, base: Column, terms: Column) -> Column:
    """The occurrences of a row's revealing terms (structs of term and disclosure, or null), but for those that touch a base span."""

    @F.arrow_udf(_MARK)
    def mark(texts: pa.Array, bases: pa.Array, termss: pa.Array) -> pa.Array:
        return _in_parts(marked, pa.list_(_MARKED), texts, bases, termss)

    def marked(texts: pa.Array, bases: pa.Array, termss: pa.Array) -> pa.Array:
        out = []
        for t, b, w in zip(texts.to_pylist(), bases.to_pylist(), termss.to_pylist()):
            if w is None:
                out.append([])
                continue
            disclosure, spans = {x["term"]: x["disclosure"] for x in w}, sorted((s["start"], s["stop"]) for s in b)
            of = {x: disclosure[d] for x in terms_of(t) if (d := _digest(x)) in disclosure}
            marks, k, reach = [], 0, 0  # reach: where the spans that begin before the word end
            for m in _TERM.finditer(t):
                while k < len(spans) and spans[k][0] < m.end():
                    reach, k = max(reach, spans[k][1]), k + 1
                if reach <= m.start() and (d := of.get(m[0].lower())) is not None:
                    marks.append({"kind": 4, "start": m.start(), "stop": m.end(), "disclosure": d})
            out.append(marks)
        return pa.array(out, pa.list_(_MARKED))

    return mark(text, base, terms)


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR, remove_from: float | None = None) -> DataFrame:
    """(id, base, terms, text_sha256, sanitised) for every row: the patterns' spans, the terms that reveal them, and the text without both.

    Spans are structs of kind (its place in KINDS), start and stop, in code
    points, ordered by kind and start; a term has its disclosure too. A term is
    a run of 2 to ``LONGEST_TERM`` letters, compared without case. It is marked
    wherever it stands, in every document, but never across a base span.
    ``sanitised`` is null where nothing is marked. A null text is an empty one.
    Repeated rows count as documents of their own and stay; null ids too; other
    columns aren't read. Patterns take time in proportion to the text, whatever
    it holds.
    """
    found = materialize(_found(docs, id_col, text_col), "pii-found")
    revealing, row_terms = disclosing_terms(found, docs, text_col=text_col, threshold=threshold, prior=prior)
    own = join_hot(row_terms, revealing, "term", n_col="n_in").groupBy("row").agg(F.collect_list(F.struct("term", "disclosure")).alias("revealed"))
    empty = F.array().cast(_MARK)
    held = found.where("text is not null").join(own, "row", "left").select("row", "text", "base", _marks(F.col("text"), F.col("base"), F.col("revealed")).alias("terms"))
    changed = [materialize(_changed(held, ["row"], remove_from), "pii-held")]
    leaking = revealing.where("n_term > n_in").select("term", "disclosure", (F.col("n_term") - F.col("n_in")).alias("n"))
    if not leaking.isEmpty():
        # Such terms are in documents without entities too. A text is written once, and met again by the marks of all its terms.
        spots = materialize(_elsewhere(docs, text_col, _term_filter(leaking)), "pii-spots")
        first = materialize(spots.groupBy("text_a", "text_b").agg(F.min("row").alias("row"), F.count("*").alias("n")).select("row", "n"), "pii-texts")
        hits = spots.select("row", "hits").join(first, "row", "left_semi").select("row", F.explode("hits").alias("hit")).select("row", "hit.term", "hit.spots")
        marks = join_hot(hits, leaking, "term").select("row", F.transform("spots", lambda x: F.struct(x["kind"], x["start"], x["stop"], F.col("disclosure").alias("disclosure"))).alias("spots"))
        marks = marks.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spots"))).alias("terms")).join(first, "row")
        texts = spots.select("row", "text_a", "text_b", "text").join(marks, "row")
        texts = texts.select(F.struct("text_a", "text_b").alias("key"), "n", "text", F.array().cast("array<struct<kind:int,start:int,stop:int>>").alias("base"), "terms")
        texts = materialize(_changed(texts, ["key", "n"], remove_from), "pii-elsewhere")
        others = materialize(found.where("text is null").select("row", F.struct("text_a", "text_b").alias("key")), "pii-others")
        few = F.octet_length("sanitised") + 64 * F.size("terms") < MOST_BROADCAST
        changed.append(join_hot(others, texts, "key", small=few).select("row", "terms", "sanitised"))
    for i, part in enumerate(changed):
        both = part if i == 0 else both.unionByName(part)
    return found.select("row", "id", "base", "text_sha256").join(both, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("terms", empty).alias("terms"), "text_sha256", "sanitised")


def _changed(rows: DataFrame, keys: list[str], remove_from: float | None) -> DataFrame:
    return rows.select(*keys, "terms", sanitised(F.col("text"), F.col("base"), F.col("terms"), REMOVE_FROM if remove_from is None else remove_from).alias("sanitised"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")


def sanitised(text: Column, base: Column, terms: Column, remove_from: float = REMOVE_FROM) -> Column:
    """The text with base spans replaced by their kind in brackets, and terms generalised ([term]) or, from ``remove_from`` on, removed.

    Of overlapping spans the first is replaced and the others that start inside it go with it.
    """

    @F.arrow_udf("string")
    def replace(texts: pa.Array, bases: pa.Array, termss: pa.Array) -> pa.Array:
        return _in_parts(replaced, pa.string(), texts, bases, termss)

    def replaced(texts: pa.Array, bases: pa.Array, termss: pa.Array) -> pa.Array:
        out = []
        for t, b, w in zip(texts.to_pylist(), bases.to_pylist(), termss.to_pylist()):
            spans = sorted([(s["start"], -s["stop"], f"[{KINDS[s['kind']]}]") for s in b or []] + [(s["start"], -s["stop"], "" if s["disclosure"] >= remove_from else "[term]") for s in w or []])
            parts, at = [], 0
            for start, stop, mark in spans:
                if start >= at:
                    parts += [t[at:start], mark]
                at = max(at, -stop)
            out.append(t if t is None else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return replace(text, base, terms)
