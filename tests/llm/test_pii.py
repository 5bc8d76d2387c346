"""Personal data: spans against plain patterns, disclosure against counts by hand."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from spanforge.llm.pii import base_spans, luhn, personal_spans, sanitised, span_text


def plain(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.", "@", ".", "c-d", "1", "23", "255", "256", "4111111111111111", " ", "-", "+", "(", ")", "x@y.z", "1.2.3.4", "é", "\n", "+1 (555) 555-1234", "a@b@c.d.e", "00012"]
    for _ in range(6000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base_spans(t) == plain(t), t
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_runs_take_no_quadratic_time():
    start = time.time()
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 400_000, "a@" * 200_000, "+1" + " " * 400_000, "1 " * 200_000):
        base_spans(t)
    assert time.time() - start < 20


def test_disclosure(spark):
    secret = "write to owner.of.boat@example.com today"
    docs = [(i, f"the captain zephyrina {secret} and sail") for i in range(6)]
    docs += [(100 + i, f"the captain sails and sail number {i} today write to") for i in range(60)]
    docs += [(200, None), (201, ""), (None, f"zephyrina {secret}"), (0, docs[0][1]), (202, "x" * 100_000 + " 10.0.0.1")]
    df = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id bigint, text string, base string")
    got = personal_spans(df).withColumn("spans", span_text(F.col("base"))).collect()
    assert len(got) == len(docs)
    texts = Counter(t or "" for _, t in docs)
    n, n_e = len(docs), sum(c for t, c in texts.items() if secret in t)
    for r in got:
        text = dict(docs)[r.doc_id] or ""
        assert [(s.kind, s.start, s.stop) for s in r.base] == plain(text)
        marked = {text[s.start : s.stop] for s in r.terms}
        want = set()
        if secret in text:
            for w in ("the", "captain", "zephyrina", "write", "to", "today", "and", "sail"):
                n_t = sum(c for t, c in texts.items() if w in t.split())
                near = sum(c for t, c in texts.items() if secret in t and w in t.split())
                if w in text.split() and near >= 3 and 1 + math.log2(near / n_t) / -math.log2(n_e / n) >= 0.95:
                    want.add(w)
            assert want == {"zephyrina"}
        assert marked == want
    clean = personal_spans(df).join(df.select("doc_id", "text").where("doc_id = 3"), "doc_id").select(sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("t")).first().t
    assert clean == "the captain  write to [email] today and sail"
    assert personal_spans(df.limit(0)).collect() == []


def test_whole_data_marks_planted_terms_of_one_and_two_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    word = docs.where("text rlike '^[A-Za-z]{3,} '").orderBy("doc_id").first().text.split(" ")[0]
    planted = [(10**6, f"{word} Quibblewick wrote one@planted.example {word}"), (10**6 + 1, "Mr Zanzibarth, two@planted.example"), (10**6 + 2, "Zanzibarth again: two@planted.example")]
    got = personal_spans(docs.unionByName(spark.createDataFrame(planted, docs.schema))).where("doc_id >= 1000000").collect()
    texts = dict(planted)
    marked = {r.doc_id: {texts[r.doc_id][s.start : s.stop] for s in r.terms} for r in got}
    assert "Quibblewick" in marked[10**6] and word not in marked[10**6]
    assert "Zanzibarth" in marked[10**6 + 1] and "Zanzibarth" in marked[10**6 + 2]


def test_whole_data_against_counts_of_all_pairs(spark):
    """Every entity with every term of every document by plain counting, rare entities and terms that leak elsewhere among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    leak = [(2 * 10**6 + i, f"call Quorvexia under +1 555 010 7777 or so" if i < 40 else "nobody knows Quorvexia, quorvexia's number") for i in range(41)]
    leak += [(3 * 10**6, leak[40][1]), (None, leak[40][1]), (3 * 10**6 + 1, "one@a.example Zedd@b.example x" + "y" * 70 + " Zedd"), (3 * 10**6 + 2, None)]
    everything = docs.unionByName(spark.createDataFrame(leak, docs.schema))
    rows = [(r.doc_id, r.text or "") for r in everything.collect()]
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{2,}", t) if len(m[0]) <= 64] for _, t in rows]
    bases = [plain(t) for _, t in rows]
    entities = [{(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for k, a, b in base} for (_, t), base in zip(rows, bases)]
    n_e, n_t, both = Counter(e for s in entities for e in s), Counter(w for x in words for w in {y[0] for y in x}), Counter()
    for s, x in zip(entities, words):
        both.update((e, w) for e in s for w in {y[0] for y in x})
    most = {}
    for (e, w), n in both.items():
        share = n_e[e] / len(rows)
        d = 1 + math.log2((n + 0.01 * share) / (n_t[w] + 0.01)) / -math.log2(share)
        if d >= 0.95:
            most[w] = max(most.get(w, 0), d)
    want = Counter()
    for (i, t), x, base in zip(rows, words, bases):
        marks = [(a, b) for w, a, b in x if w in most and not any(p < b and q > a for _, p, q in base)]
        want[i, tuple(base), tuple(marks)] += 1
    found = personal_spans(everything).collect()
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.stop) for s in r.base), tuple((s.start, s.stop) for s in r.terms)) for r in found)
    assert got == want and sum(len(k[2]) for k in want) > 50
    texts = dict(rows)
    assert {texts[r.doc_id][s.start : s.stop].lower() for r in found for s in r.terms if r.doc_id and r.doc_id == 2 * 10**6 + 40} == {"quorvexia"}
    assert all((r.sanitised is None) == (not r.base and not r.terms) for r in found)
    assert {r.sanitised for r in found if r.doc_id == 3 * 10**6} == {"nobody knows [term], [term]'s number"}


def leaking(spark, words, copies):
    """Documents with an entity and the words, and long texts without an entity that hold them too."""
    named = [(i, f"call {w} under +1 555 {i // 100:03} {i % 100:02}00, {w}") for i, w in enumerate(words) for _ in range(30)]
    text = " ".join(f"{w} and so on" for w in words) + " filler" * copies
    rows = [*named, (10**6, text), (10**6 + 1, text), (10**6 + 2, "nothing of it"), (10**6 + 3, None)]
    return text, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_long_texts_with_many_leaking_terms(spark):
    import string

    words = ["Zq" + "".join(string.ascii_lowercase[(i // 26**k) % 26] for k in range(4)) + "x" for i in range(1000)]
    text, df = leaking(spark, words, 700_000)
    got = {r.doc_id: r for r in personal_spans(df).where("doc_id >= 1000000").collect()}
    assert len(text) > 4_900_000 and got[10**6].sanitised == got[10**6 + 1].sanitised
    assert {text[s.start : s.stop] for s in got[10**6].terms} >= set(words) and got[10**6].sanitised.endswith(" filler" * 1000)
    assert not any(w in got[10**6].sanitised for w in words[:50]) and got[10**6 + 2].terms == got[10**6 + 3].terms == []


def test_full_filters_change_nothing(spark, monkeypatch):
    from spanforge.llm import pii

    _, df = leaking(spark, [f"Quorv{a}{b}ia" for a in "xyzvw" for b in "aeiou"], 3)
    rows = lambda: sorted((r.doc_id, str(r.terms), r.sanitised or "") for r in personal_spans(df).collect())
    want = rows()
    assert sum("Quorv" in r[2] for r in want) == 0 and any("[term]" in r[2] for r in want)
    for bits in (64, 1):  # nearly full, and none
        monkeypatch.setattr(pii, "MOST_BITS", bits)
        monkeypatch.setattr(pii, "TERM_BITS", 1)
        assert rows() == want


def test_query_counts_each_kind_of_any_rows(spark, tmp_path):
    """Numbers and digests of the query itself, of rows with several spans of one kind and of all kinds."""
    import hashlib

    from spanforge.llm.queries import op3_pii_disclosure

    rng = random.Random(3)
    pieces = ["x@y.z ", "a.b@c.de ", "1.2.3.4 ", "4111 1111-1111 1111 ", "+1 (555) 555-1234 ", "+49 30 1234567 ", "1.2.3.256 ", "\U0001f600", "\u0661", "word ", "\n"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "x@y.z, a@b.cd and 1.2.3.4"), (0, rows[0][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in rows:
        spans = plain(text or "")
        named = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in spans)
        want[i, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(named.encode()).hexdigest()] += 1
    got = op3_pii_disclosure(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert Counter(map(tuple, got)) == want and max(k[4] for k in want) > 1
