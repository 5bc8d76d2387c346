"""Scoring of a small corpus with one case for each behaviour, and properties of intervals."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import intervals, numeric
from spanforge.functions.canonical import corpus_digest
from spanforge.functions.numeric import Accounting, Floor, to_fixed
from spanforge.operators import accounting, measure, methods
from spanforge.sources import corpus

A = "must-redact"
CASES = [
    # id, kind, tier, family, twin_of, spans (start, end, role, envelope), findings (start, end, family, action)
    ("placeholder", "must-not-flag", "T1", "key", None, [], [(11, 30, "key", "warn")]),
    ("pending", A, "T0", "key", None, [(14, 37, "secret", None)], [(14, 37, None, None)]),
    ("envelope", A, "T1", "token", None, [(22, 57, "secret", (15, 57))], [(15, 57, "token", None)]),
    ("exact", A, "T1", "key", None, [(38, 71, "secret", None)], [(38, 71, "other", None), (38, 71, "key", None)]),
    ("companion", "policy", "T1", "pair", None, [(10, 26, "companion", None), (34, 70, "secret", None)], [(10, 26, None, None)]),
    ("overbroad", A, "T2", "key", None, [(6, 39, "secret", None)], [(0, 39, None, None)]),
    ("partial", A, "T2", "key", None, [(20, 57, "secret", None)], [(20, 40, "key", None)]),
    ("twin", "must-not-flag", "T1", "key", "exact", [], [(27, 34, "else", None)]),
]


def document():
    cases = []
    for name, kind, tier, family, twin, spans, _ in CASES:
        cases.append(
            {
                "id": name,
                "path": f"d/{name}.txt",
                "content": "x" * 80,
                "expected": [{"start": s, "end": e, "role": r} | ({"envelope": {"start": v[0], "end": v[1], "reason": "prefix"}} if v else {}) for s, e, r, v in spans],
                "grouping": {"kind": kind, "tier": tier, "family": family, "group": "g"},
            }
            | ({"twin": {"twin_of": twin, "mutation": "m", "mutation_kind": "length"}} if twin else {})
        )
    return {"schema": "s", "identity": {"source": "t", "revision": "1", "evidence_schema": "1", "corpus_digest": corpus_digest(cases)}, "cases": cases}


def observations():
    found = [{"path": f"d/{c[0]}.txt", "start": s, "end": e} | ({"family": f} if f else {}) | ({"action": a} if a else {}) for c in CASES for s, e, f, a in c[6]]
    complete = {"scanner": {"id": "a"}, "result": {"status": "complete", "findings": found}}
    return {"schema": "s", "corpus_digest": document()["identity"]["corpus_digest"], "observations": [complete, {"scanner": {"id": "b"}, "result": {"status": "timeout"}}]}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    (at / "corpus.json").write_text(json.dumps(document()))
    (at / "observations.json").write_text(json.dumps(observations()))
    cases = corpus.read_corpus(spark, str(at / "corpus.json"))
    scanners, findings, unmeasured = corpus.read_observations(spark, str(at / "observations.json"))
    return cases, scanners, findings, unmeasured


def results(loaded):
    cases, scanners, findings, unmeasured = loaded
    spans = corpus.spans_of(cases).drop("env_reason")
    return measure.score_cases(cases.drop("expected", "content", "targets"), spans, corpus.on_cases(findings, cases), scanners.drop("corpus_digest"), corpus.on_cases(unmeasured, cases))


def test_measurements(loaded):
    got = {(r.scanner, r.case_id): r for r in results(loaded).collect()}
    assert len(got) == 16 and all(r.measurement_type == "not-measured" and r.span_outcomes is None and r.flagged is None for k, r in got.items() if k[0] == "b")
    want = {"envelope": ("COVERED", 0, 0), "exact": ("EXACT", 0, 0), "companion": ("MISS", 36, 0), "overbroad": ("OVERBROAD", 0, 6), "partial": ("PARTIAL", 17, 0)}
    for name, (outcome, leaked, collateral) in want.items():
        r = got["a", name]
        assert (r.span_outcomes, r.leaked_bytes, r.collateral_bytes) == (outcome, leaked, collateral), name
    assert got["a", "pending"].measurement_type == "pending"
    r = got["a", "placeholder"]
    assert (r.flagged, r.findings, r.co_detected, r.action_counts) == (True, 1, False, "warn:1")
    r = got["a", "twin"]
    assert (r.flagged, r.findings, r.co_detected) == (False, 1, True)


def test_groups(loaded):
    groups = {r.group_key: r for r in accounting.group_counts(results(loaded)).collect()}
    assert set(groups) == {"must-not-flag/T1", "must-redact/T1", "must-redact/T2", "pending/T0", "policy/T1"}
    g = groups["must-redact/T1"]
    assert (g.files, g.spans, g.secret_bytes, g.envelope_spans, g.envelope_bytes, g.pairs, g.discriminated_strict, g.co_detected_pairs) == (2, 2, 68, 1, 7, 1, 1, 1)
    assert (g.tp, g.fp, g.fn) == (1, 1, 1)
    g = groups["must-redact/T2"]
    assert (g.leaked_spans, g.leaked_bytes, g.collateral_bytes, g.exact, g.overbroad, g.partial) == (1, 17, 6, 0, 1, 1)
    c = groups["must-not-flag/T1"]
    assert (c.files, c.flagged_files, c.findings, c.fp, c.tn) == (2, 1, 2, 2, 1)
    for r in accounting.account_groups(results(loaded)).collect():
        if r.population == "positive":
            assert r.leaked_span_rate.withheld == "insufficient-evidence" and r.pending_files == (1 if r.group_key.startswith(A) else 0)
            assert (r.twin_rate is None) == (r.pairs == 0)
        if r.population == "control":
            assert r.false_alarm_rate.withheld == "insufficient-evidence" and r.measurable_share is None


def test_corpus_is_valid_and_violations_are_found(spark, loaded):
    cases, _, findings, unmeasured = loaded
    corpus.refuse(corpus.corpus_violations(cases))
    corpus.refuse(corpus.observation_violations(findings, unmeasured, cases))
    broken = cases.where("case_id in ('exact', 'twin')").withColumn("content", F.lit("é" * 20)).unionByName(cases.where("case_id = 'exact'"))
    reasons = {r.reason for r in corpus.corpus_violations(broken).collect()}
    assert {"duplicate id", "duplicate path", "invalid range"} <= reasons
    lost = {r.reason for r in corpus.corpus_violations(cases.where("case_id <> 'exact'")).collect()}
    assert lost == {"twin of an unknown case"}
    odd = findings.limit(1).withColumns({"end_byte": F.lit(500).cast("bigint"), "labels": F.array(F.lit("b"), F.lit("a"))})
    assert {r.reason for r in corpus.observation_violations(odd, unmeasured, cases).collect()} == {"invalid range", "labels unordered, repeated or too many"}
    with pytest.raises(ValueError, match="unknown path"):
        corpus.refuse(corpus.observation_violations(findings.withColumn("path", F.lit("nowhere")), unmeasured, cases))


def test_intervals_against_sets_of_bytes(spark):
    rng = random.Random(6)
    rows = [(k, s, s + rng.randrange(1, 12), rng.random() < 0.5) for k in range(25) for s in (rng.randrange(60) for _ in range(rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, "k int, start_byte int, end_byte int, cover boolean")
    merged = intervals.merge_ranges(df, ["k"]).collect()
    for k in range(25):
        bytes_ = {b for q, s, e, _ in rows if q == k for b in range(s, e)}
        own = sorted((r.start_byte, r.end_byte) for r in merged if r.k == k)
        assert {b for s, e in own for b in range(s, e)} == bytes_ and all(a[1] < b[0] for a, b in zip(own, own[1:]))
    out = {r.k: r.outside for r in intervals.bytes_outside(df.where("not cover"), df.where("cover"), ["k"]).collect()}
    for k, n in out.items():
        a, b = ({x for q, s, e, c in rows if q == k and c is side for x in range(s, e)} for side in (False, True))
        assert n == len(a - b)
    arrays = df.groupBy("k").agg(F.collect_list(F.struct(F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))).alias("a")).select("k", intervals.union_array(F.col("a")).alias("u")).collect()
    assert {r.k: [(x.s, x.e) for x in r.u] for r in arrays} == {k: sorted((r.start_byte, r.end_byte) for r in merged if r.k == k) for k in range(25)}


def test_mappings_are_kept_and_compared(spark):
    rows = [("k", 0, 9, None, 5), ("k", 0, 9, ("source-block", 1, ["base64"]), 1), ("k", 0, 9, ("source-segment", 2, ["base64", "hex"]), 2), ("k", 0, 9, ("source-segment", 2, ["base64"]), 3), ("k", 1, 9, None, 1)]
    df = spark.createDataFrame([("s", *r, "f", None) for r in rows], "scanner string, case_id string, start_byte int, end_byte int, mapping struct<bound: string, layers: int, codecs: array<string>>, emit_seq int, family string, action string")
    got = {r.start_byte: r for r in measure.dedupe_findings(df).collect()}
    assert tuple(got[0].mapping) == ("source-segment", 2, ["base64"]) and got[0].emit_seq == 5 and got[1].mapping is None
    twice = df.where("emit_seq < 3 and start_byte = 0").withColumn("replay", F.col("emit_seq") - 1)
    roster = spark.createDataFrame([("s", 0), ("s", 1)], "scanner string, replay int")
    assert [tuple(r) for r in methods.replay_sets(twice, roster).collect()] == [("s", 1)] and methods.replay_sets(twice.drop("mapping"), roster).collect() == []


def test_a_hot_text_is_many_tasks(spark):
    """A third of all ranges in one text of megabytes: the union, shared bytes and outcomes against sets of bytes, and the plan."""
    rng = random.Random(8)
    length = 3_000_000
    rows = [("hot", s, min(length, s + rng.choice((3, 60, 900, 4000)))) for s in (rng.randrange(length - 1) for _ in range(1500))]
    rows += [("hot", 500_000, 900_000), ("hot", 899_999, 1_000_000), ("hot", 1_000_000, 1_000_001), ("hot", 2_000_000, 2_300_000)]
    rows += [(f"k{i % 200}", s, s + 20) for i in range(3000) for s in [rng.randrange(400)]]
    df = spark.createDataFrame(rows, "case_id string, start_byte bigint, end_byte bigint").withColumn("scanner", F.lit("a")).repartition(3)
    merged = intervals.merge_ranges(df, ["scanner", "case_id"], counted=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert all("slice" in line for line in plan.split("\n") if "Window" in line and "max(end_byte" in line and "max(m" not in line)
    placed = intervals.placed(df, ["scanner", "case_id"]).where("case_id = 'hot'")
    assert placed.select("slice").distinct().count() > 40
    found = merged.collect()
    assert sum(r.n for r in found) == len(rows)
    for k in ("hot", "k0", "k199"):
        covered = bytearray(length)
        for q, s, e in rows:
            if q == k:
                covered[s:e] = b"\1" * (e - s)
        own = sorted((r.start_byte, r.end_byte) for r in found if r.case_id == k)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:])) and sum(e - s for s, e in own) == sum(covered)
        assert all(all(covered[s:e]) for s, e in own)
    spans = [("hot", i, s, s + rng.choice((1, 30, 70_000))) for i in range(300) for s in [rng.randrange(length - 70_000)]] + [("hot", 300, *rows[0][1:])]
    sp = spark.createDataFrame(spans, "case_id string, span_idx int, start_byte bigint, end_byte bigint").withColumns({"role": F.lit("secret"), "env_start": F.when(F.col("span_idx") % 2 == 0, F.col("start_byte") - 100), "env_end": F.when(F.col("span_idx") % 2 == 0, F.col("end_byte") + 4000)})
    got = {r.span_idx: r.outcome for r in measure.span_outcomes(sp, df, spark.createDataFrame([("a",)], "scanner string")).collect()}
    hot = [(s, e) for q, s, e in rows if q == "hot"]
    for _, i, s, e in spans:
        a, z = (s - 100, e + 4000) if i % 2 == 0 else (s, e)
        near = [(x, y) for x, y in hot if x < e and s < y]
        inside = [(x, y) for x, y in near if x <= s and e <= y]
        want = "EXACT" if (s, e) in near else "COVERED" if any(a <= x and y <= z for x, y in inside) else "OVERBROAD" if inside else "PARTIAL" if near else "MISS"
        assert got[i] == want, (i, s, e)
    shared = intervals.shared_bytes(sp.select(F.lit("a").alias("scanner"), "case_id", "span_idx", "start_byte", "end_byte"), merged, ["scanner", "case_id"])
    islands = [(r.start_byte, r.end_byte) for r in found if r.case_id == "hot"]
    assert {r.span_idx: r.shared for r in shared.collect()} == {i: sum(max(0, min(e, y) - max(s, x)) for x, y in islands) for _, i, s, e in spans}


def test_rates(spark):
    assert to_fixed(1.005, 2) == 1.0 and to_fixed(0.5, 0) == 1.0 and to_fixed(2.5, 0) == 3.0
    rows = [(0, 0), (0, 9), (3, 4), (3, 5), (9, 9), (12, 6), (1, 1000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    config = Accounting()
    got = df.select("a", "b", numeric.proportion(F.col("a"), F.col("b"), True, config).alias("p"), numeric.ratio(F.col("a"), F.col("b"), config, n=F.lit(5).cast("bigint")).alias("r")).collect()
    for r in got:
        if r.b == 0:
            assert r.p.point is None and r.p.withheld is None and r.r.point is None
        elif r.b < 5:
            assert r.p.withheld == "insufficient-evidence" and r.p.n is None and r.r.n == r.b
        else:
            p, n, z = r.a / r.b, r.b, 1.96
            assert r.p.n == r.b and r.p.point == to_fixed(p, 6)
            if p > 1:
                assert r.p.bound is None
            else:
                centre, scale = (p + z * z / (2 * n)) / (1 + z * z / n), 1 + z * z / n
                assert abs(r.p.bound - min(1, centre + z / scale * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5)) < 1e-6 and r.p.bound >= r.p.point - 1e-6
    with pytest.raises(ValueError):
        Accounting(min_denominator=0)
    with pytest.raises(ValueError):
        Accounting(twin_coverage_floor=Floor(0.5, {"policy": 1.5}))
