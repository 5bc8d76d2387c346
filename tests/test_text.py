"""Text positions, codecs, variants, reports and streaming."""

import base64
import json
import random
import zlib

from pyspark.sql import functions as F

from spanforge.functions import codecs, text
from spanforge.operators import variants
from spanforge.sources import reports
from spanforge.streaming import score


def test_utf16_and_occurrences():
    t = "a🙂é\n🙂"
    assert text.utf16_to_bytes(t, [0, 1, 2, 3, 4, 5, 6, 7, 8]) == [0, 1, None, 5, 7, 8, None, 12, None]
    assert text.occurrences("aaaa", "aa") == [0, 1, 2] and text.occurrences("é1é1", "1") == [2, 5] and text.occurrences("a", "") == []


def test_byte_spans_and_lines(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["é", "1.2.3.4", "\n", " ", "x", "🙂"]) for _ in range(30))) for i in range(40)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    import re

    for r in df.select("i", "t", text.regex_byte_spans(F.col("t"), r"[0-9]\.[0-9]\.[0-9]\.[0-9]").alias("s")).collect():
        want = [(len(r.t[: m.start()].encode()), len(r.t[: m.end()].encode())) for m in re.finditer(r"[0-9]\.[0-9]\.[0-9]\.[0-9]", r.t or "")]
        assert [(s.start_byte, s.end_byte) for s in r.s or []] == want
    one = spark.createDataFrame([("é\nb\n", 0), ("é\nb\n", 3), ("é\nb\n", 5)], "t string, b int").select(text.line_of(F.col("t"), F.col("b")).alias("l")).collect()
    assert [r.l for r in one] == [1, 2, 3]
    ranges = spark.createDataFrame([("é1", 0, 2), ("é1", 1, 2), ("é1", 0, 1), ("é1", 2, 4), ("é1", 2, 2)], "t string, a int, b int")
    assert [r.v for r in ranges.select(text.valid_range(F.col("t"), F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False, False, False]


def test_codecs(spark):
    assert codecs.base64_strict("YQ==") == b"a" and codecs.base64_strict("YR==") is None and codecs.base64_strict("YQ") is None and codecs.base64_strict("YQ", padded=False) == b"a"
    assert codecs.base64_strict("-_8=", url=True) == b"\xfb\xff" and codecs.base64_strict("-_8=") is None and codecs.base64_strict("") is None and codecs.base64_strict("Y Q=") is None
    assert codecs.uri_component("a%20b+c%C3%A9") == "a b+cé" and codecs.uri_component("%C3") is None and codecs.uri_component("%2") is None
    assert codecs.percent_spans("x=p%40ss p@ss", "p@ss") == [(2, 8), (9, 13)]
    inner = base64.b64encode(b"secret-value-1").decode()
    twice = base64.b64encode(f"pre {inner}".encode()).decode()
    assert codecs.decoded_runs(f"é {twice} end", "secret-value-1") == [(3, 3 + len(twice))]
    assert codecs.decoded_runs(f"{inner} {inner}", "secret-value-1") == [] and codecs.decoded_runs("nothing here", "secret") == []
    assert codecs.postgres_parts("postgres://u:p%40@h:5432/db?x=1") == {"user": "u", "password": "p@", "host": "h", "port": "5432", "database": "db"}
    assert codecs.postgres_parts("mysql://u@h/db") is None
    df = spark.createDataFrame([("YQ==", "0aFf"), ("bad!", "0A"), (None, "zz"), ("YQ==", "0a\n")], "b string, h string")
    got = df.select(codecs.base64_bytes(F.col("b")).alias("b"), *[codecs.hex_strict(F.col("h"), c).alias(c) for c in ("lower", "upper", "mixed")]).collect()
    assert [r.b and bytes(r.b) for r in got] == [b"a", None, None, b"a"]
    assert [(r.lower and bytes(r.lower), r.upper and bytes(r.upper), r.mixed and bytes(r.mixed)) for r in got] == [(None, None, b"\x0a\xff"), (None, b"\x0a", None), (None, None, None), (None, None, None)]


def test_validators():
    """Values made by the stated rules: CRC-32 in seven digits of base 36 with a length before it, in base64, and decimal heads."""
    valid = codecs.VALIDATORS
    crc36 = lambda t: codecs.base36(zlib.crc32(t.encode())).rjust(7, "0")
    head = "abcDEF_123-" * 3
    token = lambda p, n: (x := f"{p}-{head}.01.{n}") + crc36(x)
    for prefix, name, other in (("glpat", "gitlab-routable-personal-access-token", False), ("glrt", "gitlab-runner-authentication-token", True)):
        good = token(prefix, "0x")  # 33 characters
        assert valid[name](good) and not valid[name](token(prefix, "0w")) and not valid[name](good[:-1] + ("0" if good[-1] != "0" else "1"))
        assert valid[name](f"{prefix}-plain") is other and valid[name](good + "x") is other
    body = "A" * 54
    tail = base64.b64encode(zlib.crc32(body.encode()).to_bytes(4, "little")).decode()[:6]
    assert valid["confluent-cloud-api-secret"](f"cflt{body}{tail}") and not valid["confluent-cloud-api-secret"](f"cflt{body}{tail[:-1]}!") and not valid["confluent-cloud-api-secret"]("cflt")
    decimal = base64.urlsafe_b64encode(b"123456789012345678").decode()
    for text, ok in ((f"{decimal}.x.y", True), (decimal.rstrip("="), True), (base64.b64encode(b"7").decode(), True), (base64.b64encode(b"12a").decode(), False), ("", False), ("é", False), ("MTIz MTIz", True), ("M", False)):
        assert valid["discord-bot-token"](text) is ok, text
    assert codecs.crc32_latin1("é") == zlib.crc32(b"\xe9") and codecs.crc32_latin1("aé🔑") == zlib.crc32("aé".encode("latin-1") + b"\x3d\x11")


def test_variants_keep_the_secret(spark):
    df = spark.createDataFrame([(1, "ключ=tok_abc\nx", 9, 16), (2, "k='tok_z'", 3, 8)], "case_id int, content string, start_byte long, end_byte long")
    for r in variants.context_variants(df).collect():
        if r.supported:
            assert r.content.encode()[r.start_byte : r.end_byte].decode() == {1: "tok_abc", 2: "tok_z"}[r.case_id]
        else:
            assert r.content is None
    assert {r.operator for r in variants.context_variants(df).where("case_id = 2 and not supported").collect()} == {"context.single-quote", "context.yaml"}
    crlf = {r.case_id: r for r in variants.crlf_variants(df).collect()}
    assert crlf[1].content == "ключ=tok_abc\r\nx" and not crlf[2].supported
    for r in variants.lexical_variants(df, "^tok_[a-z]+$").collect():
        assert r.content.encode()[r.start_byte : r.end_byte].decode() == r.value and r.strategy == ("derived" if r.operator == "lexical.length-minus-one" and r.case_id == 1 else "review-required")


def test_reports(spark, tmp_path):
    lines = [
        {"rule": "r", "path": "a", "line": 1, "value": "dup", "tags": []},
        {"rule": "r", "path": "a", "value": "dup", "tags": ["decoded:base64"], "line": 1},
        {"rule": "r", "path": "a", "line": 2, "value": "dup"},
        {"rule": "q", "path": "b", "value": "one"},
        {"rule": "q", "path": "b", "value": "gone"},
        {"rule": "q", "path": "nowhere", "value": "x"},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    rows, malformed = reports.read_lines(spark, str(tmp_path / "r.json"), reports.VALUE_ROW)
    assert malformed.count() == 1
    rows = reports.drop_decoded_duplicates(rows)
    assert rows.count() == 5
    cases = spark.createDataFrame([("a", "é dup\ndup dup"), ("b", "one")], "path string, content string")
    found, failed = reports.locate_values(rows, cases, "s")
    assert sorted((r.path, r.start_byte, r.end_byte) for r in found.collect()) == [("a", 3, 6), ("a", 7, 10)]
    assert sorted((r.path, r.reason) for r in failed.collect()) == [("b", "ambiguous-location"), ("nowhere", "unknown-path")]
    shim = [{"path": "c", "start": 2, "end": 3, "label": "l"}, {"path": "c", "start": 1, "end": 3, "label": "l", "type": "t"}, {"done": True, "findings": 3}]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, shim)))
    rows, _ = reports.read_lines(spark, str(tmp_path / "o.json"), reports.OFFSET_ROW)
    found, problems = reports.map_offsets(rows, spark.createDataFrame([("c", "🙂é")], "path string, content string"), "s")
    assert [(r.start_byte, r.end_byte, r.family) for r in found.collect()] == [(4, 6, "l")]
    assert sorted(r.reason for r in problems.collect()) == ["count doesn't match", "offset not on a code point"]


def test_stream_scores_like_a_table(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0, "secret", 10, 20, 8, 22), (1, 1, "secret", 30, 40, None, None)], "case_id int, span_idx int, role string, start_byte int, end_byte int, env_start int, env_end int")
    rows = [("s", 1, 8, 22), ("s", 1, 0, 12), ("s", 1, 30, 40), ("t", 1, 5, 50), ("t", 2, 1, 2)]
    findings = spark.createDataFrame(rows, "scanner string, case_id int, start_byte int, end_byte int")
    findings.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(findings.schema).parquet(str(tmp_path / "in"))
    out = score.best_touch(score.touches(stream, spans)).writeStream.outputMode("complete").format("memory").queryName("touches").trigger(availableNow=True).start()
    out.awaitTermination(60)
    got = sorted(map(tuple, spark.table("touches").collect()))
    assert got == sorted(map(tuple, score.best_touch(score.touches(findings, spans)).collect()))
    assert got == [("s", 1, 0, "COVERED"), ("s", 1, 1, "EXACT"), ("t", 1, 0, "OVERBROAD"), ("t", 1, 1, "OVERBROAD")]


def test_base64_of_whole_texts(spark, tmp_path):
    import hashlib

    from spanforge.plans.queries import QUERIES

    rows = [(1, "é日x" * 700_000), (2, "a" * 41), (3, "a" * 40), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n, r.decoded_md5) for r in QUERIES["base64_strict_whole"](spark, str(tmp_path)).selectExpr("doc_id", "length(encoded) AS n", "decoded_md5").collect()}
    size = lambda t: -(-len(t.encode()) // 3) * 4
    assert got == {i: (t if t is None else size(t), hashlib.md5(t.encode()).hexdigest() if t else None) for i, t in rows}
