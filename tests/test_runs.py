"""Whole runs over documents, artifacts, reuse, representation facts, and rules of methods and performance."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.functions.numeric import Floor
from spanforge.operators import methods, perf, representation
from spanforge.sources.artifact import changed_tables, read_artifact
from spanforge.plans.runs import RunConfig, capabilities, commit_run, measurement_run, method_run, pin_violations, reuse_decisions, variant_plan, write_run
from spanforge.sources import corpus
from tests.test_measure import document, observations


def written(tmp_path, cases_reversed=False, digest=None):
    doc, obs = document(), observations()
    obs["corpus_digest"] = digest or obs["corpus_digest"]
    if cases_reversed:
        doc["cases"].reverse()
        obs["observations"].reverse()
    (tmp_path / "c.json").write_text(json.dumps(doc))
    (tmp_path / "o.json").write_text(json.dumps(obs))
    return str(tmp_path / "c.json"), str(tmp_path / "o.json")


def test_run_is_the_same_in_any_order(spark, tmp_path):
    config, manifests = RunConfig(("a", "b"), jobs=3, reference="a"), []
    for k, reverse in enumerate((False, True)):
        (at := tmp_path / str(k)).mkdir()
        run = measurement_run(spark, *written(at, reverse), config, str(at / "work"))
        manifests.append(write_run(run, str(at / "out"), config))
        assert {r.status for r in run.comparisons.collect()} == {"incomplete"}
    assert manifests[0] == manifests[1] and manifests[0]["tables"]["cases"]["rows"] == 16
    assert RunConfig(("b", "a"), jobs=1, reference="a").config_hash() == config.config_hash() != RunConfig(("a",)).config_hash()
    assert json.loads(spark.read.text(str(tmp_path / "0/out/manifest")).first().value) == manifests[0]
    assert "EXACT" in capabilities()["outcomes"]


def test_stale_observations_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        measurement_run(spark, *written(tmp_path, digest="other"), RunConfig(("a",)), str(tmp_path / "work"))


def test_reuse_and_pins(spark):
    now = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("c", "1", None)], "scanner string, version string, mode string")
    then = spark.createDataFrame([("a", "1", None), ("b", "2", None)], "scanner string, version string, mode string")
    assert sorted(map(tuple, reuse_decisions(now, then, ["version", "mode"]).collect())) == [("a", "reuse", ""), ("b", "rerun", "version,mode"), ("c", "run", "")]
    pins = spark.createDataFrame([("a", "p", "1"), ("a", "q", "1"), ("b", "p", "1")], "scanner string, component string, digest string")
    seen = spark.createDataFrame([("a", "p", "1"), ("a", "q", "2")], "scanner string, component string, digest string")
    assert sorted(map(tuple, pin_violations(pins, seen).collect())) == [("a", "q", "digest differs"), ("b", "p", "missing component")]


def test_decoded_facts(spark):
    step = lambda data, **s: representation.decode_step(data, s)
    assert step(b"YQ==", codec="base64") == b"a" and step(b"YQ", codec="base64") is None and step(b"YQ", codec="base64", padding="unpadded") == b"a"
    assert step(b"0a", codec="hex") == b"\n" and step(b"0A", codec="hex") is None and step(b"0A", codec="hex", case="upper") == b"\n" and step(b"0 ", codec="hex") is None and step(b"\xff", codec="hex") is None
    rows = [("é 6162 63", [(3, 7), (8, 10)], [("hex", None), ], hashlib.sha256(b"abc").hexdigest(), 3), ("é 6162 63", [(3, 7)], [("hex", None)], hashlib.sha256(b"abc").hexdigest(), 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, f array<struct<start:int,end:int>>, s array<struct<codec:string,`case`:string>>, d string, n int")
    got = df.select(representation.decoded_matches(F.col("t"), F.col("f"), F.col("s"), F.col("d"), F.col("n")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, None]
    chunks = spark.createDataFrame([(1, "aé", [1]), (2, "aé", [2]), (3, "aé", [1, 1]), (4, "aé", [3]), (5, "a", [])], "case_id int, content string, boundaries array<int>")
    assert sorted((r.case_id, r.reason) for r in representation.chunk_problems(chunks).collect()) == [(2, "inside a code point"), (3, "not rising"), (4, "outside the text")]


def test_line_chunks(spark):
    texts = ["", "a\n", "aa\nbb\ncc", "é\n" * 5, "\n\n", "x" * 20 + "\ny"]

    def plain(t):
        out, current = [], b""
        for line in t.encode().split(b"\n"):
            line += b"\n"
            if current and len(current) + len(line) > 6:
                out.append(current)
                current = b""
            current += line
        return b"".join([*out, current])[: len(t.encode())], t

    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.line_chunks(F.col("t"), 6).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c.encode()) <= 6 or c.count("\n") <= 1 for c in r.c)
        assert all(len((a + b.split("\n")[0] + "\n").encode()) > 6 for a, b in zip(r.c, r.c[1:])) and plain(r.t)


def test_directions(spark):
    rows = []
    for cell, shift, noise in (("same", 0, 0), ("fast", -200, 0), ("slow", 200, 0), ("noisy", -200, 400), ("zero", 0, 0)):
        for k in range(10):
            base = 0 if cell == "zero" else 1000 + k
            rows += [(cell, "baseline", k, base), (cell, "candidate", k, base + shift), (cell, "control", k, base + noise)]
    df = spark.createDataFrame(rows, "cell string, arm string, round int, ns bigint")
    got = {r.cell: r.direction for r in perf.latency_directions(df, ["cell"]).collect()}
    assert got == {"same": "indistinguishable", "fast": "faster", "slow": "slower", "noisy": "indistinguishable", "zero": "indistinguishable"}
    t = {(r.cell, r.arm): (r.n, r.min_ns, r.median_ns) for r in perf.timing_summary(df, ["cell", "arm"]).collect()}
    assert t["same", "baseline"] == (10, 1000, 1004)
    runs = spark.createDataFrame([("a", "faster"), ("a", "faster"), ("b", "faster"), ("b", "slower"), ("c", "faster"), ("d", "indistinguishable"), ("d", "indistinguishable")], "cell string, direction string")
    assert sorted(map(tuple, perf.confirm(runs, ["cell"]).collect())) == [("a", 2, "confirmed-faster"), ("b", 2, "unconfirmed"), ("d", 2, "no-evidence")]


def test_method_cases_and_delta(spark):
    cases = spark.createDataFrame([("p", "must-redact", "T1", None, None), ("t2", "must-not-flag", "T1", "p", None), ("t1", "must-not-flag", "T1", "p", None), ("c", "must-not-flag", "T0", None, "x")], "case_id string, kind string, tier string, twin_of string, taxonomy string")
    got = {r.eval_id: r for r in methods.method_cases(cases).collect()}
    assert set(got) == {"p--differential", "t1--differential", "t2--differential", "c--differential", "t1--twin", "t2--twin", "c--benign", "p--metamorphic", "c--metamorphic", "p--mutation", "c--mutation"}
    assert got["p--mutation"].twin_id == "t1" and got["t2--twin"].seed_id == "p" and got["c--benign"].taxonomy == "pending"
    assert {r.method for r in methods.method_cases(cases, ["twin"]).collect()} == {"twin"}
    counts = spark.createDataFrame([("mutation", "s", "must-redact:T1->must-redact:T2", 1, 2, 3, 0), ("differential", "u", "must-redact:T1", 1, 0, 4, 5)], "method string, scanner string, stratum string, pass long, fail long, review_required long, not_measured long")
    r = methods.assertion_delta(counts, ["u"], Floor(0.9, {"differential": 0.0})).collect()
    assert len(r) == 1 and (r[0].group_key, r[0].v10_total, r[0].total, r[0].causes) == ("must-redact/T1", 11, 16, "unresolved,unstable")


def test_a_changed_corpus_with_an_old_digest_is_refused(spark, tmp_path):
    c, o = written(tmp_path)
    doc = json.loads((tmp_path / "c.json").read_text())
    shown = corpus.document_digests(spark, c).first()
    assert shown.declared == shown.corpus_digest == corpus.seal("t", "1", "1", list(reversed(doc["cases"])))["identity"]["corpus_digest"]
    lines = [f'{{"path":"{x["path"]}","sha256":"sha256:{hashlib.sha256(x["content"].encode()).hexdigest()}"}}' for x in sorted(doc["cases"], key=lambda x: x["path"])]
    assert shown.input_digest == "sha256:" + hashlib.sha256(f"[{','.join(lines)}]".encode()).hexdigest()
    doc["cases"][0]["grouping"]["note"] = "an unknown field counts too"
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert corpus.document_digests(spark, c).first().input_digest == shown.input_digest
    with pytest.raises(ValueError):
        measurement_run(spark, c, o, RunConfig(("a",)), str(tmp_path / "work"))


def test_rules_of_twins_and_siblings(spark, tmp_path):
    doc = document()
    twin = next(c for c in doc["cases"] if "twin" in c)
    for field, value, reason in (("mutation", " ", "twin without mutation"), ("sibling_family", "key", "sibling blank, padded, without a family or the family itself"), ("sibling_family", " x", "sibling blank, padded, without a family or the family itself")):
        twin["twin"] = {"twin_of": "exact", "mutation": "m", "mutation_kind": "length"} | {field: value}
        (tmp_path / "c.json").write_text(json.dumps(doc))
        found = corpus.corpus_violations(corpus.read_corpus(spark, str(tmp_path / "c.json"))).collect()
        assert [(r.case_id, r.reason) for r in found] == [("twin", reason)]


def test_sibling_findings_are_co_detections(spark, tmp_path):
    doc, obs = document(), observations()
    next(c for c in doc["cases"] if "twin" in c)["twin"]["sibling_family"] = "wide"
    doc = corpus.seal("t", "1", "1", doc["cases"])
    obs["corpus_digest"] = doc["identity"]["corpus_digest"]
    obs["observations"][0]["result"]["findings"] = [{"path": "d/twin.txt", "start": 0, "end": 5, "family": "both"}]
    (tmp_path / "c.json").write_text(json.dumps(doc))
    (tmp_path / "o.json").write_text(json.dumps(obs))
    for covers, want in ((["key"], (True, False)), (["key", "wide"], (False, True)), ([], (False, True))):
        coverage = spark.createDataFrame([("both", covers)], "family string, covers array<string>")
        run = measurement_run(spark, str(tmp_path / "c.json"), str(tmp_path / "o.json"), RunConfig(("a",)), str(tmp_path / "work"), coverage)
        row = run.cases.where("case_id = 'twin'").first()
        assert (row.flagged, row.co_detected) == want, covers


def test_method_run(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(document()))
    cases = corpus.read_corpus(spark, str(tmp_path / "c.json"))
    contracts = spark.createDataFrame([("key", "^x+$")], "family string, pattern string")
    plan = variant_plan(cases.withColumn("taxonomy", F.lit("prose")), contracts, str(tmp_path))
    scanners = spark.createDataFrame([("a", "complete"), ("b", "complete")], "scanner string, status string")
    findings = spark.createDataFrame([("a", "exact--differential--canonical", 38, 71, "key", None, 0)], "scanner string, case_id string, start_byte bigint, end_byte bigint, family string, action string, emit_seq int")
    unmeasured = spark.createDataFrame([], "scanner string, case_id string")
    run = method_run(plan, findings, scanners, unmeasured, RunConfig(("a", "b"), reference="a"), str(tmp_path))
    different = run.comparisons.where("disagreement <> 'none'").collect()
    assert [(r.case_id, r.peer, r.disagreement) for r in different] == [("exact--differential--canonical", "b", "reference-only")]
    assert run.review.where("kind = 'disagreement'").count() == 1 and run.review.where("kind = 'pending-expectation'").count() > 0
    assert run.assertions.count() == sum(r.total for r in run.resolution.collect()) and run.unresolved.count() >= 0
    assert {"variants", "assertions", "summary_by_method", "summary_attempts"} <= set(run.tables())
    config = RunConfig(("a", "b"), reference="a")
    manifest = commit_run(run, str(tmp_path / "artifact"), config)
    assert set(manifest["tables"]) == set(run.tables()) and manifest["facts"] == {"config_hash": config.config_hash(), "kind": "method-run"}
    assert read_artifact(spark, str(tmp_path / "artifact"))["variants"].count() == plan.count() and changed_tables(spark, str(tmp_path / "artifact")) == []
