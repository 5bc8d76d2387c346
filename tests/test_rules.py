"""Grammars, evidence files, outcomes of processes and replays, scope of labels, rules of plans."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import codecs, grammars
from spanforge.functions.canonical import canonical_json, sha256_text
from spanforge.operators import accounting, outcomes
from spanforge.operators.evaluation import observe_variants
from spanforge.operators.generation import SPAN, generate, plan_violations
from spanforge.plans.runs import variant_plan
from spanforge.sources.evidence import read_evidence


def test_grammars(spark):
    good = {
        "slug": "a 9a a-b 0-", "dotted-slug": "a.b 1.2-", "fixture-path": "a a/b.txt .a/..b a/...", "release-tag": "v1.0 A_b-", "git-revision": "0" * 40,
        "code-point": "U+0041 U+FFFF U+1F511 U+10FFFF U+D7FF U+E000 U+0D7FF U+00D7FF U+0DFF U+0D800".replace(" U+0D800", ""), "native-label": "~unrecognized a:b A_1", "sha256": "sha256:" + "a" * 64,
    }
    bad = {
        "slug": "A -a a.b", "dotted-slug": ".a a_b", "fixture-path": "/a a//b a/./b ../a a/.. a/ a\\b", "release-tag": "-v .v", "git-revision": "0" * 39 + " " + "A" * 40,
        "code-point": "U+D800 U+DFFF U+110000 U+41 U+0D800 U+00DFFF u+0041 U+00aF", "native-label": "~other :a", "sha256": "sha256:" + "A" * 64 + " " + "a" * 64,
    }
    rows = [(g, v, want) for values, want in ((good, True), (bad, False)) for g, text in values.items() for v in text.split(" ")] + [(g, "", False) for g in good] + [(g, v.split(" ")[0] + "\n", False) for g, v in good.items()]
    df = spark.createDataFrame(rows, "g string, v string, want boolean")
    fits = F.lit(None).cast("boolean")
    for g in grammars.GRAMMARS:
        fits = F.when(F.col("g") == g, grammars.fits(F.col("v"), g)).otherwise(fits)
    assert [(r.g, r.v) for r in df.withColumn("got", fits).collect() if r.got != r.want] == []
    given = {"choice": "3", "on": "true", "x1": "-1.5e3", "name": '"text"', "1x": "1", "a-b": "1", "n": "null", "none": None}
    assert spark.createDataFrame([(given,)], "p map<string,string>").select(grammars.safe_parameters(F.col("p")).alias("p")).first().p == {"choice": "3", "on": "true", "x1": "-1.5e3"}


def test_lenient_base64():
    assert codecs.base64_lenient("YW-Jj ZA==ignored") == b"abcd"[:4] and codecs.base64_lenient("Y") == b"" and codecs.base64_lenient("YQ") == b"a" and codecs.base64_lenient("=YQ") == b""


def test_evidence(spark):
    file = {"schema": "e/v1", "families": {"f": {"pattern": "^a+$", "segments": {"delimiter": ".", "removable": [1]}}, "g": {}}, "validators": {"f": "discord-bot-token"}, "benign_taxonomies": ["prose"], "classification_allowlist": True}
    found = read_evidence(spark, json.dumps(file).encode(), "e/v1")
    assert sorted(map(tuple, found.contracts.collect())) == [("f", "^a+$", "discord-bot-token", ".", [1]), ("g", None, None, None, None)]
    assert found.taxonomies == {"prose"} and found.allowlist == {"f", "g"} and found.digest == sha256_text(canonical_json(file))
    for change in ({"schema": "x"}, {"other": 1}, {"validators": {"h": "discord-bot-token"}}, {"validators": {"f": "unknown"}}, {"benign_taxonomies": [" "]}, {"families": []}):
        with pytest.raises(ValueError):
            read_evidence(spark, json.dumps(file | change).encode(), "e/v1")


def test_outcomes_and_replays(spark):
    rows = [("a", 0, "exited", 0), ("a", 1, "exited", 0), ("b", 0, "exited", 0), ("b", 1, "timed-out", None), ("c", 0, "exited", 3), ("c", 1, "not-found", None), ("d", 0, "exited", 0), ("e", 0, "exited", 0), ("e", 1, "exited", 0), ("f", 0, "exited", 0), ("f", 1, "exited", 0), ("g", 0, "exited", None), ("g", 1, "exited", 0)]
    runs = outcomes.process_status(spark.createDataFrame(rows, "scanner string, replay int, outcome string, code int"))
    found = [("a", "x", 0, 1, "k", r) for r in (0, 1)] + [("e", "x", 0, 1, "k", 0), ("e", "x", 0, 1, "other", 1), ("f", "y", 0, 1, "k", 0), ("f", "y", 0, 1, "k", 1)]
    findings = spark.createDataFrame([(s, c, a, b, k, None, r) for s, c, a, b, k, r in found], "scanner string, case_id string, start_byte int, end_byte int, family string, action string, replay int")
    unmeasured = spark.createDataFrame([("f", "z", "why", 1), ("a", "z", "why", 0), ("a", "z", "why", 1)], "scanner string, case_id string, reason string, replay int")
    observed, divergent = outcomes.collate_replays(runs, findings, unmeasured, 2)
    assert {r.scanner: (r.status, r.divergent_cases) for r in observed.collect()} == {"a": ("complete", 0), "b": ("timeout", None), "c": ("error", None), "d": ("error", None), "e": ("unstable", 1), "f": ("unstable", 1), "g": ("error", None)}
    assert {tuple(r) for r in divergent.collect()} == {("e", "x"), ("f", "z")}


def test_scope(spark):
    table = spark.createDataFrame([("a", "credential", "unresolved"), ("b", "other", "not-credential"), ("c", "ambiguous", "unresolved"), ("m", "credential", "mapped")], "label string, scope string, status string")
    rows = [(1, "fam", ["b"]), (2, None, []), (3, None, ["~unrecognized"]), (4, None, ["a"]), (5, None, ["b"]), (6, None, ["a", "b"]), (7, None, ["c"]), (8, None, ["m"]), (9, None, ["a", "new"])]
    findings = spark.createDataFrame([(i, "s", f, x) for i, f, x in rows], "finding_id int, scanner string, family string, labels array<string>")
    got = {r.finding_id: (r.disposition, r.conflicting) for r in accounting.classify_findings(findings, table).collect()}
    assert got == {1: ("mapped-credential", False), 2: ("native-label-unavailable", False), 3: ("unrecognized-label", False), 4: ("credential-related-unmapped", False), 5: ("out-of-scope", False), 6: ("ambiguous", True), 7: ("ambiguous", False), 8: ("ambiguous", False), 9: ("ambiguous", True)}
    totals, labels = accounting.scope_totals(findings, table)
    row = totals.first()
    assert (row.findings, row.ambiguous, row.multi_label, row.conflicting) == (9, 4, 2, 2)
    assert {r.label: (r.findings, r.with_family, r.status) for r in labels.collect()}["b"] == (3, 1, "not-credential")


def test_plan_rules(spark):
    schema = f"case_id string, content string, expected array<{SPAN}>, kind string, tier string, family string, targets array<string>, taxonomy string, twin_of string, mutation string, mutation_kind string"
    rows = [("a", "abc", [(0, 1, "secret", None)], "must-redact", "T1", None, ["Bad"], None, None, None, None), ("b", "abc", [], "must-not-flag", "T1", None, [], "odd", None, None, None), ("c", "abc", [(2, 9, "secret", None)], "must-redact", "T1", None, [], None, None, None, None), ("t", "abd", [], "must-not-flag", "T1", None, [], None, "b", "m", "x")]
    found = {(r.eval_id, r.reason) for r in plan_violations(spark.createDataFrame(rows, schema), ["benign", "twin", "differential"], ["prose"]).collect()}
    assert found == {("a--differential", "target is no slug"), ("b--benign", "control without a known taxonomy"), ("c--differential", "invalid ranges"), ("t--twin", "twin of a case without a secret")}


def test_evidence_files_name_their_validators(spark):
    names = ["legacy:discord-bot-token", "legacy:confluent-cloud-api-secret", "legacy:gitlab-routable-optional", "legacy:gitlab-routable-required"]
    file = {"schema": "e/v1", "families": {f"f{k}": {"pattern": "^.+$"} for k in range(4)}, "validators": {f"f{k}": name for k, name in enumerate(names)}}
    assert sorted((r.family, r.validator) for r in read_evidence(spark, json.dumps(file).encode(), "e/v1").contracts.collect()) == [(f"f{k}", name) for k, name in enumerate(names)]
    VALIDATORS = codecs.VALIDATORS
    assert VALIDATORS[names[2]]("anything") and not VALIDATORS[names[3]]("anything") and VALIDATORS[names[0]]("MTIz.x.y") and not VALIDATORS[names[0]]("YWJj.x.y")


TWINS = f"case_id string, path string, content string, expected array<{SPAN}>, kind string, tier string, family string, targets array<string>, taxonomy string, twin_of string, mutation string, mutation_kind string, sibling string"


def twin_rows(k=0, sibling=None, path="t.txt"):
    positive = (f"p{k}", f"{k}/p.txt", "key=abc;", [(4, 7, "secret", None)], "must-redact", "T1", "fam", ["t"], None, None, None, None, None)
    return [positive, (f"t{k}", path and f"{k}/{path}", "key=abd;", [], "must-not-flag", "T1", "fam", ["t"], None, f"p{k}", "m", "alphabet", sibling)]


def test_authored_twins_and_their_siblings(spark, tmp_path):
    """A twin of its seed's path is an error; others must flip, and are read within their family with the sibling family apart."""
    contracts = spark.createDataFrame([("fam", "^[a-z]+$")], "family string, pattern string")
    # (sibling, family of the finding): flagged, co-detected.
    asked = [(None, "fam", (True, False)), (None, None, (True, False)), (None, "other", (False, True)), (None, "wide", (True, False)), ("sib", "wide", (False, True)), ("sib", "fam", (True, False)), ("fam", "fam", (False, True))]
    rows = [r for k, (sibling, _, _) in enumerate(asked) for r in twin_rows(k, sibling)] + twin_rows(8, path="p.txt") + twin_rows(9, path=None)
    generate(spark.createDataFrame(rows, TWINS), contracts, ["twin"]).write.parquet(str(tmp_path / "v"))
    variants = spark.read.parquet(str(tmp_path / "v"))
    made = {r.seed_id: r for r in variants.where("operator = 'authored.twin'").collect()}
    assert {k: r.status for k, r in made.items()} == {f"p{k}": "error" if k == 8 else "generated" for k in (*range(7), 8, 9)}
    found = [("s", made[f"p{k}"].case_id, 0, 3, family, None, 0) for k, (_, family, _) in enumerate(asked)]
    findings = spark.createDataFrame(found, "scanner string, case_id string, start_byte int, end_byte int, family string, action string, emit_seq int")
    coverage = spark.createDataFrame([("wide", ["fam", "sib"])], "family string, covers array<string>")
    scanners, none = spark.createDataFrame([("s", "complete")], "scanner string, status string"), spark.createDataFrame([], "scanner string, case_id string")
    read = {r.case_id: (r.flagged, r.co_detected) for r in observe_variants(variants, findings, scanners, none, coverage).where("operator = 'authored.twin'").collect()}
    assert [read[made[f"p{k}"].case_id] for k in range(7)] == [want for _, _, want in asked]


def test_plans_that_break_rules_are_refused(spark, tmp_path):
    contracts = spark.createDataFrame([("fam", "^[a-z]+$")], "family string, pattern string")
    control = ("n", "n.txt", "plain", [], "must-not-flag", "T1", None, ["t"], "odd", None, None, None, None)
    cases = spark.createDataFrame([*twin_rows(), control], TWINS)
    assert variant_plan(cases, contracts, str(tmp_path), taxonomies=["odd"]).count() > 0
    with pytest.raises(ValueError, match="control without a known taxonomy"):
        variant_plan(cases, contracts, str(tmp_path), taxonomies=["prose"])
    # A policy case without a secret is a benign case that is no control; a control with one is none.
    policy = spark.createDataFrame([("q", "q.txt", "plain", [], "policy", "T1", None, ["t"], "odd", None, None, None, None), ("r", "r.txt", "plain", [(0, 2, "secret", None)], "must-not-flag", "T1", None, ["t"], "odd", None, None, None, None)], TWINS)
    assert [(r.eval_id, r.reason) for r in plan_violations(policy, ["benign"]).collect()] == [("q--benign", "benign case is no control")]
