"""Scoring in one shuffle by text, and generation in one by case: results against plain loops, and the shuffles of their plans."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spanforge.functions.intervals import SLICE_BYTES
from spanforge.operators import accounting, evaluation, measure
from spanforge.operators.generation import generate
from tests.test_generation import CASES, ROWS


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def corpus(spark, seed=3):
    rng = random.Random(seed)
    at = lambda: rng.choice((0, 1, 2)) * SLICE_BYTES + rng.randrange(-40, 40) + 60
    cases, spans, findings = [], [], []
    for k in range(40):
        case = f"c{k}"
        cases.append((case, "must-not-flag" if k % 4 == 3 else "must-redact", "T0" if k % 9 == 0 else "T1", f"f{k % 2}", f"c{k - 1}" if k % 8 == 7 else None))
        place = 100
        for i in range(rng.randrange(1, 4) if k % 4 < 3 else 0):
            start = max(place, at())
            end = start + rng.choice((5, 30, SLICE_BYTES + 9))
            envelope = (start - 3, end + 3) if rng.random() < 0.5 else (None, None)
            spans.append((case, i, "companion" if i == 1 else "secret", start, end, *envelope))
            place = end + 10
        for _ in range(rng.randrange(0, 12)):
            own = [s for s in spans if s[0] == case]
            if own and rng.random() < 0.4:
                s = rng.choice(own)
                grow = rng.choice((0, 2, 9))
                start, end = s[3] - grow, s[4] + grow
            else:
                start = at()
                end = start + rng.choice((1, 20, SLICE_BYTES, 2 * SLICE_BYTES + 5))
            start = max(start, 0)
            findings += [(rng.choice("abz"), case, start, end, rng.choice(("f0", "f1", None)), rng.choice(("warn", None)), len(findings))] * rng.choice((1, 2))
    return cases, spans, findings


def expected(cases, spans, findings):
    out = {}
    for case, kind, tier, family, twin in cases:
        for scanner in "abx":
            last = {(s, e): (f, a) for sc, c, s, e, f, a, _ in findings if (sc, c) == (scanner, case)}
            mine = [s for s in spans if s[0] == case]
            held = lambda rs: {b for s, e in rs for b in range(s, e)}
            if scanner == "x" or (scanner, case) == ("a", "c5"):
                out[scanner, case] = ("not-measured",)
            elif tier == "T0":
                out[scanner, case] = ("pending",)
            elif kind == "must-not-flag":
                other = sum(twin is not None and f is not None and f != family for f, _ in last.values())
                counts = Counter(a for _, a in last.values() if a)
                out[scanner, case] = ("control", len(last), other < len(last), other > 0, ",".join(f"{a}:{n}" for a, n in sorted(counts.items())) or None)
            else:
                union, outcomes, leaked = held(last), [], 0
                for _, _, role, s, e, a, z in mine:
                    if role == "secret":
                        inside = [(x, y) for x, y in last if x <= s and y >= e]
                        lo, hi = (s, e) if a is None else (a, z)
                        o = "EXACT" if (s, e) in last else "COVERED" if any(x >= lo and y <= hi for x, y in inside) else "OVERBROAD" if inside else "PARTIAL" if any(x < e and s < y for x, y in last) else "MISS"
                        outcomes.append(o)
                        leaked += len(held([(s, e)]) - union) if o in ("PARTIAL", "MISS") else 0
                accepted = held([(s, e) if a is None else (a, z) for _, _, _, s, e, a, z in mine])
                exact = {(s, e) for _, _, r, s, e, _, _ in mine if r == "secret" and (s, e) in last}
                out[scanner, case] = ("positive", ",".join(outcomes), leaked, len(union - accepted), len(last) - len(exact)) if outcomes else ("positive", None, None, None, None)
    return out


def test_scores_of_long_texts(spark):
    cases, spans, findings = corpus(spark)
    df = measure.score_cases(
        spark.createDataFrame(cases, "case_id string, kind string, tier string, family string, twin_of string"),
        spark.createDataFrame(spans, "case_id string, span_idx int, role string, start_byte bigint, end_byte bigint, env_start bigint, env_end bigint"),
        spark.createDataFrame(findings, "scanner string, case_id string, start_byte bigint, end_byte bigint, family string, action string, emit_seq int"),
        spark.createDataFrame([("a", "complete"), ("b", "complete"), ("x", "timeout")], "scanner string, status string"),
        spark.createDataFrame([("a", "c5"), ("a", "c5")], "scanner string, case_id string"),
    )
    got = {}
    for r in df.collect():
        more = {"positive": (r.span_outcomes, r.leaked_bytes, r.collateral_bytes, r.fp), "control": (r.findings, r.flagged, r.co_detected, r.action_counts)}
        got[r.scanner, r.case_id] = (r.measurement_type, *more.get(r.measurement_type, ()))
    assert got == expected(cases, spans, findings) and len({v[0] for v in got.values()}) == 4
    outcomes = {o for v in got.values() if v[0] == "positive" and v[1] for o in v[1].split(",")}
    assert outcomes == set(measure.OUTCOMES)


def test_scoring_shuffles_by_text(spark):
    ids = spark.range(1000)
    cases = ids.selectExpr("id as case_id", "'must-redact' as kind", "'T1' as tier", "'f' as family", "cast(null as bigint) as twin_of")
    spans = ids.selectExpr("id as case_id", "0 as span_idx", "'secret' as role", "1L as start_byte", "5L as end_byte", "cast(null as bigint) as env_start", "cast(null as bigint) as env_end")
    findings = ids.selectExpr("'a' as scanner", "id as case_id", "1L as start_byte", "5L as end_byte", "'f' as family", "'x' as action", "id as emit_seq")
    df = measure.score_cases(cases, spans, findings, spark.createDataFrame([("a", "complete")], "scanner string, status string"), ids.selectExpr("'a' as scanner", "id as case_id").where("case_id < 0"))
    # First slices: findings, spans (twice), cases, twins, unmeasured; other slices: findings and spans, and what comes of each.
    assert shuffles(df) <= 10
    assert {r.span_outcomes for r in df.select("span_outcomes").distinct().collect()} == {"EXACT"}


def test_selection_counts_each_case_once(spark):
    """T0 cases and twins that are assigned, not assigned, in the group's suite and in another."""
    rows = [
        # scanner, case, kind, tier, twin_of, suite, measurement_type
        ("s", 1, "must-redact", "T1", None, "x", "positive"), ("s", 2, "must-not-flag", "T1", 1, "x", "control"), ("s", 3, "must-redact", "T0", None, "x", "pending"),
        ("s", 4, "must-redact", "T0", None, "y", "pending"), ("s", 5, "must-redact", "T0", 1, "x", "pending"), ("s", 6, "must-redact", "T1", 1, "x", "positive"),
        ("s", 7, "must-redact", "T1", 1, "y", "positive"), ("s", 8, "must-redact", "T0", 1, "x", "pending"),
    ]
    zeros = {c: F.when(F.col("measurement_type") == "positive", F.lit(1).cast("long")) for c in accounting.SUMS}
    results = spark.createDataFrame(rows, "scanner string, case_id bigint, kind string, tier string, twin_of bigint, suite string, measurement_type string").withColumns(zeros)
    control = F.col("measurement_type") == "control"
    results = results.withColumns({"findings": F.when(control, F.lit(0).cast("long")), "flagged": F.when(control, F.lit(False)), "co_detected": F.when(control, F.lit(False))})
    chosen = spark.createDataFrame([(k, "t") for k in (1, 3, 4, 8)], "case_id bigint, target string")
    got = {r.group_key: (r.files, r.pending_files, r.pairs) for r in accounting.account_selections(results, chosen).where("target = 't'").collect()}
    # Of must-redact/T1: case 1 and its twin 6; pending 3 and 8 by suite x, and 5, a twin that isn't assigned; 4 and 7 are of another suite.
    assert got == {"must-redact/T1": (2, 3, 2), "pending/T0": (3, 0, 0)}


def test_generation_shuffles_by_case(spark):
    ids = spark.range(100).selectExpr("concat('c', id) as case_id", "'x=Q' as content", "array() as expected", "'must-not-flag' as kind", "'T2' as tier", "'fam' as family", "array('t') as targets", "'prose' as taxonomy", "cast(if(id % 2 = 1, concat('c', id - 1), null) as string) as twin_of", "'m' as mutation", "'context' as mutation_kind")
    cases = ids.withColumn("expected", F.array().cast(dict(spark.createDataFrame(ROWS, CASES).dtypes)["expected"]))
    contracts = spark.createDataFrame([("fam", "^x", ".", [1])], "family string, pattern string, delimiter string, removable array<bigint>")
    made = generate(cases, contracts)
    # Cases, twins, and the first twin of each.
    assert shuffles(made) <= 3
    assert made.where("method = 'twin'").select("eval_id").distinct().count() == 50
    assert {r.operator for r in evaluation.attempts(made).collect()} == {r.operator for r in made.where("operator <> 'identity'").select("operator").distinct().collect()}
