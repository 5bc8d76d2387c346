"""WARC archive, line dedup and Poisson mixing: edge cases, and rules against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm.line_frequency import drop_site_boilerplate
from spanforge.llm.poisson_mix import mix_sources, source_rates
from spanforge.llm.warc_archive import read_archive, write_archive

PAGES = "page_id bigint, url string, html string, sha256 string, payload int"


def test_archive_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\r\nX: y", other), (4, "c", "small"), (5, "d", "small"), (6, "e", None), (7, "f", ""), (None, "g", big), (2, "h", big), (8, "i", "\x00" * 1200)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    archive = write_archive(df, str(tmp_path / "archive"))
    assert spark.read.parquet(archive.payloads).count() == len({r[2] or "" for r in rows})
    got = read_archive(spark, archive).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for page, url, html in rows:
        data = (html or "").encode()
        match = [r for r in by[page] if r.url == (url or "").replace("\r", "%0D").replace("\n", "%0A")]
        assert len(match) == 1 and bytes(match[0].payload) == data
        r = match[0]
        revisit = html == big and page != 2
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (2 if revisit else None)
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", head + b"\r\n")
        assert re.search(rb"\r\nWARC-Record-ID: <urn:page:%d>\r\n" % page if page is not None else rb"\r\nWARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>\r\n", head + b"\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r.header) == head + b"\r\n\r\n"
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == (0 if revisit else len(data))
        assert body == (b"" if revisit else data) + b"\r\n\r\n"
        assert re.search(rb"sha1:(\w+)", head)[1].decode() == hashlib.sha1(data).hexdigest()


def test_archive_detects_changed_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 50)], "page_id bigint, url string, html string")
    archive = write_archive(df, str(tmp_path / "a"))
    bad = spark.read.parquet(archive.payloads).withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="does not match its digests"):
        read_archive(spark, type(archive)(str(tmp_path / "bad"), archive.records)).collect()


def test_archive_empty(spark, tmp_path):
    archive = write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "empty"))
    assert read_archive(spark, archive).collect() == []


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, text, host in rows:
        if text is not None:
            pages[host] += 1
            seen.update({(host, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (seen[host, x.strip(" ")] >= least and seen[host, x.strip(" ")] > ratio * pages[host])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(spark):
    rows = [(i, f"menu\nbody {i}\n  menu \n\nbody {i}", "a") for i in range(20)]
    rows += [(100 + i, "rare" if i < 2 else f"text {i}", "b") for i in range(30)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "menu", None), (203, "menu", None), (204, "menu", None), (205, "menu\n" + "long " * 50000, "a"), (None, "menu", "a"), (None, "menu", "a")]
    schema = "doc_id bigint, text string, source string, `__key` string, lines_in string, `a.b` int"
    df = spark.createDataFrame([(*r, "k", "x", 1) for r in rows], schema)
    got = drop_site_boilerplate(df, max_ratio=0.2)
    assert got.columns == ["doc_id", "text", "source", "__key", "a.b", "lines_in", "lines_dropped"]
    found = [(r.doc_id, r.text, r.lines_in, r.lines_dropped) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_lines(rows, 0.2, 3), key=repr)
    assert drop_site_boilerplate(df.limit(0)).collect() == []


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else "small", 7) for i in range(4000)] + [(None, None, None, 7), (5, "t5", "big", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    rates = {r.source: r.rate for r in source_rates(df).collect()}
    got = mix_sources(df).collect()
    counts = Counter((r.doc_id, r.source) for r in got)
    for i, _, source, _ in rows:
        u = (int(hashlib.md5(f"count:20:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert counts[i, source] == poisson(rates[source], u) * (2 if i == 5 else 1)
    by = Counter(r.source for r in got)
    assert abs(by["small"] / by["big"] - 1 / 3) < 0.06  # sqrt(400) : sqrt(3600)
    assert len({(r.doc_id, r.copy) for r in got}) >= len(got) - counts[5, "big"] and {r.copy for r in got} >= {0}
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mix_sources(df.limit(0)).collect() == []


def test_mixing_given_weights(spark):
    df = spark.createDataFrame([(i, "x", "a" if i < 2000 else "b") for i in range(2200)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("b", 9.0), ("c", 5.0)], "source string, weight double")
    got = mix_sources(df, weights, size=0.5)
    by = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(by) == {"b"} and abs(by["b"] - 1100) < 150
    huge = spark.createDataFrame([(1, "x", "a")] + [(i, "x", "b") for i in range(2, 3000)], "doc_id bigint, text string, source string")
    assert mix_sources(huge, spark.createDataFrame([("a", 1.0)], "source string, weight double")).count() > 2500
