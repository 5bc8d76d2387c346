"""Places of reported values against a plain search of each value on its own."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.sources import placement, reports
from spanforge.sources.placement import address_key, decode_run, escape_pattern, expand_runs, place_all

WHOLE = "path string, raw string, rule string, value string, line bigint, tags array<string>"


def b64(text):
    return base64.b64encode(text.encode()).decode()


def plain(content, value, line):
    """Every value on its own, as a pattern."""
    raw, v = content.encode(), value.encode()
    found = [(i, i + len(v)) for i in range(len(raw)) if raw[i : i + len(v)] == v]
    if not found and re.search(rb"%[0-9A-Fa-f]{2}", v):
        found = [m.span() for m in re.finditer(escape_pattern(v), raw, re.S)]
    return [(s, e) for s, e in found if line is None or raw[:s].count(b"\n") + 1 == line]


def test_one_pass_finds_what_single_searches_find():
    rng = random.Random(2)
    letters = ["a", "b", "é", "\n", "%41", "%2F", "/", "%2f", "%C3%A9", "A", "%25", "%"]
    for _ in range(400):
        content = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        asked = [{"kind": "plain", "value": "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))), "line": rng.choice((None, 1, 2)), "codecs": None} for _ in range(12)]
        for q, got in zip(asked, place_all(content, asked)):
            assert got == plain(content, q["value"], q["line"]), (content, q)


def test_escapes_in_either_case():
    asked = [{"kind": "plain", "value": v, "line": None, "codecs": None} for v in ("p%40ss%2Fw", "p%40ss/w", "%C3%a9", "none%20")]
    assert place_all("p@ss/w p%40ss%2fw é %c3%A9", asked) == [[(0, 6), (7, 17)], [(0, 6)], [(21, 27)], []]


def test_blocks_and_decoded_lines():
    block = f"-----BEGIN RSA PRIVATE KEY-----\r\n{b64('inner é')}\r\n-----END RSA PRIVATE KEY-----"
    content = f"é\n{block}\n{block.replace('RSA', 'EC', 1)}\npw={b64('token=secret-value')}&x=1\n"
    value = "-----BEGIN RSA PRIVATE KEY-----\r\ninner é\r\n-----END RSA PRIVATE KEY-----"
    line = 2 + 2 + 2 + 1 + 1
    run = content.encode().index(b64("token=secret-value").encode())
    asked = [
        {"kind": "key-block", "value": value, "line": 2, "codecs": None},
        {"kind": "key-block", "value": value, "line": 3, "codecs": None},
        {"kind": "key-block", "value": value, "line": None, "codecs": None},
        {"kind": "decoded-line", "value": "secret-value", "line": line, "codecs": None},
        {"kind": "decoded-line", "value": "pw=token", "line": line, "codecs": None},
        {"kind": "decoded-line", "value": "value&x", "line": line, "codecs": None},
        {"kind": "decoded-line", "value": "pw=", "line": line, "codecs": None},
    ]
    end = run + len(b64("token=secret-value"))
    assert place_all(content, asked) == [[(3, 3 + len(block))], [], [], [(run, end)], [(run - 3, end)], [(run, end + 2)], []]


def test_addresses():
    assert address_key("postgres://u%40:p@h:5433/db") == (("u@", "p", "h", "5433"), "db")
    assert address_key("POSTGRESQL://u:p@h") == (("u", "p", "h", "5432"), "")
    for bad in ("postgres://u@h/db", "postgres://u:p@h:99999/db", "mysql://u:p@h/db", "postgres://u:%zz@h/db", "postgres://u:p@h h/db"):
        assert address_key(bad) is None
    content = "see postgres://u:p@h/db?x=1, and (postgresql://u:p@h:5432/other) xpostgres://u:p@h/db"
    asked = [{"kind": "address", "value": "postgres://u:p@h:5432/db", "line": None, "codecs": c} for c in (None, ["db"], ["none"])]
    assert [[content[s:e] for s, e in x] for x in place_all(content, asked)] == [["postgres://u:p@h/db?x=1", "postgresql://u:p@h:5432/other"], ["postgres://u:p@h/db?x=1"], []]


def test_runs():
    assert decode_run(b64("hello wörld"), "base64") == "hello wörld" and decode_run("68656c6c6f", "hex") == "hello"
    assert decode_run("aGVsbG8", "base64") == "hello" and decode_run("aGVsbG9=", "base64") is None and decode_run("68656", "hex") is None and decode_run("a-b/aaaa", "base64") is None
    assert expand_runs(f"x {b64('inner text')} y", "base64") == "x inner text y" and expand_runs("x y", "base64") is None


def located(spark, rows, cases, **options):
    df = spark.createDataFrame([(p, f"{i:04}", r, v, n, t) for i, (p, r, v, n, t) in enumerate(rows)], WHOLE)
    found, failed = reports.locate_values(df, spark.createDataFrame(cases, "path string, content string"), "s", **options)
    places = sorted((r.path, r.start_byte, r.end_byte, r.mapping and (r.mapping.bound, r.mapping.layers, tuple(r.mapping.codecs))) for r in found.collect())
    return places, {r.path: r.reason for r in failed.collect()}


@pytest.mark.parametrize("most", [4096, 2])
def test_reports_are_placed(spark, monkeypatch, most):
    monkeypatch.setattr(placement, "MOST_VALUES", most)
    twice, inner = b64("deep secret one"), "key=deep secret one"
    cases = [
        ("plain", "tok tok\ntok"), ("over", "aaa"), ("few", "x tok"), ("percent", "u:p@ss/w"), ("many", "tok tok"), ("lost", "nothing"), ("text", None), ("twice", f"{b64(b64(inner))}\n{twice} {twice}"), ("mixed", b64(inner).encode().hex()),
    ]
    tags = lambda *c, depth=1: [*(f"decoded:{x}" for x in c), f"decode-depth:{depth}"]
    rows = [("plain", "r", "tok", None, [])] * 2 + [("plain", "r", "tok", 2, None)]
    rows += [("over", "r", "aa", None, [])] * 2 + [("few", "r", "tok", None, [])] * 3 + [("percent", "r", "p%40ss%2Fw", 1, [])] + [("many", "r", "tok", 1, [])] * 3
    rows += [("lost", "r", "tok", None, []), ("lost", "r", "nothing", None, []), ("nowhere", "r", "tok", None, []), ("text", "r", "tok", None, []), ("few", "r", "x", 1, [])]
    rows += [("twice", "r", inner, 1, tags("base64", depth=2)), ("twice", "r", "deep secret", 2, tags("base64")), ("twice", "r", "deep secret", 2, tags("base64")), ("mixed", "r", "deep secret one", None, tags("hex", "base64", depth=2))]
    places, failed = located(spark, rows, cases, decoded=True)
    n, long = len(twice), len(b64(b64(inner)))
    segment = lambda layers, *codecs: ("source-segment", layers, codecs)
    assert places == sorted(
        [("plain", 0, 3, None), ("plain", 4, 7, None), ("plain", 8, 11, None), ("over", 0, 2, None), ("over", 1, 3, None), ("percent", 2, 8, None), ("few", 0, 1, None)] + [("few", 2, 5, None)] * 3
        + [("twice", 0, long, segment(2, "base64")), ("twice", long + 1, long + 1 + n, segment(1, "base64")), ("twice", long + 2 + n, long + 2 + 2 * n, segment(1, "base64")), ("mixed", 0, 2 * len(b64(inner)), segment(2, "base64", "hex"))],
        key=lambda x: (x[0], x[1], x[2]),
    )
    assert failed == {"many": "ambiguous-location", "lost": "ambiguous-location", "nowhere": "unknown-path", "text": "ambiguous-location"}
    # Without it, the rules for one layer of base64 on one line apply.
    places, failed = located(spark, rows, cases)
    assert [p for p in places if p[0] in ("twice", "mixed")] == [] and failed["twice"] == failed["mixed"] == "ambiguous-location"
    only = [("one", "r", "deep secret", 1, tags("base64"))]
    assert located(spark, only, [("one", f"é={twice};")]) == ([("one", 3, 3 + n, ("source-segment-extended", 1, ("base64",)))], {})


def test_too_many_runs_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(placement, "MAX_RUNS", 3)
    content = "\n".join([" ".join(["abcdefgh"] * 3 + [b64("deep secret one")]), b64("deep secret two")])
    rows = [("a", "r", "deep secret two", 2, ["decoded:base64", "decode-depth:1"]), ("b", "r", "deep secret one", 1, ["decoded:base64", "decode-depth:1"])]
    asked = placement.searches(spark.createDataFrame([(p, f"{i}", r, v, n, t) for i, (p, r, v, n, t) in enumerate(rows)], WHOLE).withColumn("emit_seq", F.lit(1)), [reports.decoded_rule()])
    got = {r.path: r.reason for r in placement.place(asked, spark.createDataFrame([("a", content), ("b", content)], "path string, content string")).collect()}
    assert got == {"a": None, "b": "ambiguous-location"}
    assert located(spark, [], [("a", "x")]) == ([], {})


def test_rules_of_rows(spark):
    key, secret = "AKIA" + "Q" * 16, "s" * 40
    rows = [("pair", key, f"{key}:{secret}"), ("pair", key, "odd"), ("joined", "tok_12shop.example", ""), ("joined", "odd", ""), ("other", "x", ""), (None, "x", "")]
    df = spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "path string, emit_seq int, rule string, value string, whole string")
    none = F.lit(None)
    rules = [placement.pair_rule(F.col("rule") == "pair", F.col("value"), F.col("whole"), "^([A-Z]{20}):(.{40})$", F.lit(1)), placement.joined_rule(F.col("rule") == "joined", F.col("value"), "^(tok_[0-9]+)([a-z.]+)$", none)]
    got = sorted((r.emit_seq, r.part, r.value, r.line, r.keeps, r.reason) for r in placement.searches(df, rules).collect() if r.value)
    assert got == [(0, 0, key, 1, True, None), (0, 1, secret, None, True, None), (2, 0, "shop.example", None, False, None), (2, 1, "tok_12", None, True, None)]
    assert sorted(r.emit_seq for r in placement.searches(df, rules).where("reason is not null").collect()) == [1, 3, 4, 5]
