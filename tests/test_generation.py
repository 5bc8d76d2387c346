"""Generated variants and their evaluation, against results by hand."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions.canonical import seeded_choice
from spanforge.operators import evaluation
from spanforge.sources.store import materialize
from spanforge.operators.generation import CONTEXT_OPERATORS, FAILED, MUTATIONS, SPAN, UNSUPPORTED, envelopes_meet_spans, generate, valid_spans

CASES = f"case_id string, content string, expected array<{SPAN}>, kind string, tier string, family string, targets array<string>, taxonomy string, twin_of string, mutation string, mutation_kind string"


def span(a, b, role="secret", envelope=None):
    return (a, b, role, envelope)


ROWS = [
    ("a", "ключ=AB_cd.e🔑\nnext", [span(9, 20, "secret", (8, 21, "quotes")), span(21, 25, "companion")], "must-redact", "T1", "fam", ["t"], None, None, None, None),
    ("a2", "ключ=AB_cd.x\nnext", [], "must-not-flag", "T1", "fam", ["t"], None, "a", "last letter", "alphabet"),
    ("a3", "# test\nключ=AB_cd.e🔑\nnext", [], "must-not-flag", "T1", "fam", [], None, "a", "a comment", "context"),
    ("b", 'say "hi"\r\n', [], "must-not-flag", "T0", None, [], None, None, None, None),
    ("c", "x=Q", [span(2, 3)], "must-redact", "T2", "fam", [], None, None, None, None),
    ("d", "plain", [], "must-not-flag", "T2", None, ["u", "v"], "prose", None, None, None),
]


@pytest.fixture(scope="module")
def made(spark):
    cases = spark.createDataFrame(ROWS, CASES)
    contracts = spark.createDataFrame([("fam", "^[A-Z]{1,2}_cd[.][a-z]", ".", [1])], "family string, pattern string, delimiter string, removable array<bigint>")
    return cases, contracts, {(r.eval_id, r.operator): r for r in generate(cases, contracts).collect()}


def test_choices_follow_the_stated_json(spark):
    row = spark.range(1).select(seeded_choice(F.lit("s"), F.lit("op"), F.lit(1000)).alias("x"), seeded_choice(F.lit('q"\\'), F.lit("op"), F.lit(7)).alias("y")).first()
    assert row.x == 575 and 0 <= row.y < 7


def test_cases_and_statuses(made):
    _, _, got = made
    evals = {k[0] for k in got}
    assert evals == {f"{r[0]}--differential" for r in ROWS} | {"a2--twin", "a3--twin", "b--benign", "d--benign"} | {f"{c}--{m}" for c in "abcd" for m in ("metamorphic", "mutation")}
    assert all(got[e, "identity"].status == "generated" and got[e, "identity"].variant == "canonical" for e in evals)
    assert {k[1] for k in got if k[0] == "a--mutation"} == {"identity", "authored.twin", *MUTATIONS} and {k[1] for k in got if k[0] == "c--mutation"} == {"identity", *MUTATIONS}
    assert {k[1] for k in got if k[0] == "a--metamorphic"} == {"identity", *CONTEXT_OPERATORS}
    assert got["b--benign", "identity"].taxonomy == "pending" and got["d--benign", "identity"].taxonomy == "prose"
    assert {o for o in CONTEXT_OPERATORS if got["b--metamorphic", o].status == "unsupported"} == {"context.json", "context.quote", "context.single-quote", "context.yaml", "context.markdown", "encoding.crlf"}
    assert got["b--metamorphic", "encoding.crlf"].reason == UNSUPPORTED
    assert {got["d--mutation", o].status for o in MUTATIONS} == {"unsupported"}


def test_offsets_follow_the_edit(made):
    _, _, got = made
    value = lambda r, k=0: r.content.encode()[r.expected[k].start : r.expected[k].end].decode()
    for o in ("context.unicode-prefix", "context.indent", "encoding.crlf"):
        r = got["a--metamorphic", o]
        assert (value(r), value(r, 1)) == ("AB_cd.e🔑", "next") and r.relation == "same-detection" and r.strategy == "derived" and r.effect == "preserve"
    assert got["a--metamorphic", "context.json"].status == "unsupported"
    m = {o: got["a--mutation", o] for o in MUTATIONS}
    assert {o: value(r) for o, r in m.items() if o not in ("lexical.prefix-change", "boundary.remove-delimiter", "structural.remove-segment")} == {
        "lexical.length-minus-one": "AB_cd.e�", "lexical.length-plus-one": "AB_cd.e🔑A", "lexical.replace-last": "AB_cd.e�A", "lexical.invalid-alphabet": "AB_cd.e�!",
    }
    assert all(value(r, 1) == "next" and r.expected[0].envelope.end == r.expected[0].end + 1 for r in m.values())
    assert value(m["lexical.prefix-change"])[1:] == "B_cd.e🔑" and value(m["lexical.prefix-change"])[0] not in "A"
    assert (value(m["boundary.remove-delimiter"]), m["boundary.remove-delimiter"].parameter) in [("ABcd.e🔑", 2), ("AB_cde🔑", 5)]
    assert (value(m["structural.remove-segment"]), m["structural.remove-segment"].parameter) == ("AB_cd", 1)
    plus, cut = m["lexical.length-plus-one"], m["structural.remove-segment"]
    assert (plus.strategy, plus.relation, plus.tier, plus.family, plus.effect, plus.property) == ("derived", "same-detection", "T1", "fam", "preserve", "length")
    assert (cut.strategy, cut.relation, cut.tier, cut.family, cut.effect, cut.kind) == ("review-required", None, "T0", None, "defer", "must-redact")
    short = got["c--mutation", "lexical.length-minus-one"]
    assert (short.status, short.reason, short.content) == ("error", FAILED, None)  # an empty secret
    assert got["c--mutation", "boundary.remove-delimiter"].status == "unsupported" and got["c--mutation", "structural.remove-segment"].status == "error"


def test_authored_twins(made):
    _, _, got = made
    for e, kind in (("a2--twin", "alphabet"), ("a3--twin", "context")):
        r = got[e, "authored.twin"]
        assert (r.status, r.relation, r.strategy, r.property, r.effect, r.case_id, r.path) == ("generated", "must-flip", "authored", kind, "invalidate", f"{e}--authored-twin", f"cases/{e}/authored.twin.txt")
    assert got["a--mutation", "authored.twin"].content == ROWS[1][1]  # the first twin by id


def test_broken_twins_and_parameters(spark, made):
    _, contracts, _ = made
    rows = [("p", "k=secret!", [span(2, 9)], "must-redact", "T1", "fam", [], None, None, None, None)]
    broken = {"same": "k=secret!", "prefix": "j=secreT!", "blank": "k=secreT!", "ctx": "k=secret! secret!", "inside": "k=secreX! k=secret!", "family": "k=secreT!"}
    rows += [(k, t, [], "must-not-flag", "T1", "other" if k == "family" else "fam", [], None, "p", " " if k == "blank" else "m", "context" if k in ("ctx", "inside") else "alphabet") for k, t in broken.items()]
    got = {r.eval_id: r.status for r in generate(spark.createDataFrame(rows, CASES), contracts, ["twin"]).where("operator = 'authored.twin'").collect()}
    assert got == {f"{k}--twin": "error" for k in broken}
    chosen = spark.createDataFrame([("mutation", "boundary.remove-delimiter", 5), ("mutation", "structural.remove-segment", 0), ("mutation", "lexical.prefix-change", 24), ("mutation", "lexical.replace-last", 0)], "method string, operator string, parameter bigint")
    again = {r.operator: r for r in generate(spark.createDataFrame(ROWS, CASES), contracts, ["mutation"], chosen).where("eval_id = 'a--mutation'").collect()}
    assert again["boundary.remove-delimiter"].content.split("\n")[0] == "ключ=AB_cde🔑" and again["lexical.prefix-change"].content.startswith("ключ=Z")
    assert again["structural.remove-segment"].status == again["lexical.replace-last"].status == "unsupported"


def test_range_rules(spark):
    rows = [("abcdef", [span(0, 2), span(2, 4)], True), ("abcdef", [span(2, 4), span(0, 2)], False), ("abc", [span(1, 1)], False), ("abc", [span(1, 4)], False), ("abcdef", [span(0, 2, "secret", (0, 3, "r")), span(2, 4)], False), ("abcdef", [span(1, 2, "secret", (0, 3, " "))], False), ("abcdef", [span(1, 2, "secret", (0, 3, "r"))], True), ("", [], True)]
    df = spark.createDataFrame(rows, f"t string, e array<{SPAN}>, ok boolean")
    assert all(r.got == r.ok for r in df.select("ok", valid_spans(F.col("t"), F.col("e")).alias("got")).collect())
    assert [r.x for r in df.select(envelopes_meet_spans(F.col("e")).alias("x")).collect()] == [False] * 4 + [True] + [False] * 3


def test_evaluation(spark, made):
    cases, contracts, got = made
    variants = materialize(generate(cases, contracts), "variants")
    scanners = spark.createDataFrame([("s", "complete"), ("gone", "timeout")], "scanner string, status string")
    secret = lambda r: next(((x.start, x.end) for x in r.expected if x.role == "secret"), None)
    rows = []
    for (e, o), r in got.items():
        if r.status == "generated" and (at := secret(r)) and o != "context.indent":
            rows.append(("s", r.case_id, *at, "fam", None, len(rows)))
    rows.append(("s", "a2--twin--authored-twin", 9, 12, "other", None, 900))
    rows.append(("s", "a3--twin--authored-twin", 0, 3, None, None, 901))
    findings = spark.createDataFrame(rows, "scanner string, case_id string, start_byte bigint, end_byte bigint, family string, action string, emit_seq int")
    unmeasured = spark.createDataFrame([("s", "c--metamorphic--context-yaml", "x")], "scanner string, case_id string, reason string")
    seen = materialize(evaluation.observe_variants(variants, findings, scanners, unmeasured), "observed")
    kinds = {(r.scanner, r.case_id): r for r in seen.collect()}
    assert {r.measurement_type for k, r in kinds.items() if k[0] == "gone"} == {"not-measured"}
    flip = kinds["s", "a2--twin--authored-twin"]
    assert (flip.measurement_type, flip.flagged, flip.co_detected) == ("control", False, True)  # another family's finding
    assert kinds["s", "a3--twin--authored-twin"].flagged and kinds["s", "b--benign--canonical"].measurement_type == "pending"
    assert kinds["s", "a--mutation--structural-remove-segment"].measurement_type == "pending"
    asserted = materialize(evaluation.variant_assertions(seen, scanners), "asserted")
    by = {(r.scanner, r.eval_id, r.variant, r.candidate): r for r in asserted.collect()}
    assert not any(k[1].endswith("differential") for k in by)
    assert ("s", "c--metamorphic", "context.yaml", None) not in by and ("s", "c--metamorphic", None, "context.yaml") not in by
    assert by["gone", "c--metamorphic", "context.yaml", None].status == "not-measured" and not any(k[0] == "gone" and k[3] for k in by)
    assert by["s", "a2--twin", None, "authored.twin"].status == "pass" and by["s", "a3--twin", None, "authored.twin"].status == "fail"
    assert by["s", "a2--twin", None, "authored.twin"].stratum == "must-redact:T1->must-not-flag:T1"
    assert by["s", "a--metamorphic", None, "context.indent"].status == "fail" and by["s", "a--metamorphic", None, "context.unicode-prefix"].status == "pass"
    assert by["s", "a--mutation", "structural.remove-segment", None].status == "review-required" and ("s", "a--mutation", None, "structural.remove-segment") not in by
    tables = {k: df.collect() for k, df in evaluation.summaries(asserted, variants).items()}
    total = sum(r["pass"] + r.fail + r.review_required + r.not_measured for r in tables["by_method"])
    assert total == len(by) and {r.target for r in tables["by_target"]} == {"t", "u", "v", "unassigned"}
    assert {(r.target, r.taxonomy) for r in tables["axes"]} == {("unassigned", "pending"), ("u", "prose"), ("v", "prose")}
    attempts = {r.operator: (r.generated, r.unsupported, r.error) for r in tables["attempts"]}
    assert attempts["authored.twin"] == (3, 0, 0) and attempts["lexical.length-minus-one"] == (1, 2, 1) and attempts["context.indent"] == (4, 0, 0)
    assert evaluation.exit_code(scanners.where("scanner = 's'"), variants.where("status <> 'error'"), asserted) == 0
    assert evaluation.exit_code(scanners, variants.where("status <> 'error'"), asserted) == 1 and evaluation.exit_code(scanners.where("scanner = 's'"), variants, asserted) == 1
    assert evaluation.exit_code(scanners.where("scanner = 's'"), variants.where("status <> 'error'"), asserted, fail_on_assertions=True) == 1
    assert {r.case_id for r in evaluation.pending_expectations(variants).collect()} >= {"a--mutation--structural-remove-segment"}
