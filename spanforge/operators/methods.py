"""Method evaluation: assertions, relations, differential comparison, review and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.accounting import strict
from spanforge.operators.measure import KEY, classify_ranges


def absolute_assertions(rows: DataFrame) -> DataFrame:
    """(.., assertion, status) for measured rows with tier, strategy and a measurement.

    Review is required where the strategy says so or the tier is T0. A positive
    passes if every span is acceptable and no byte is collateral, a control if
    it isn't flagged. Rows that aren't measured are not-measured.
    """
    review = (F.col("strategy") == "review-required") | (F.col("tier") == "T0")
    positive = F.col("has_secret")
    passed = F.coalesce(F.when(positive, strict() & (F.col("collateral_bytes") == 0)).otherwise(~F.col("flagged")), F.lit(False))
    unmeasured = F.col("measurement_type") == "not-measured"
    assertion = F.when(unmeasured | review, "absolute").when(positive, "present-within-envelope").otherwise("absent")
    status = F.when(unmeasured, "not-measured").when(review, "review-required").when(passed, "pass").otherwise("fail")
    return rows.withColumns({"assertion": assertion, "status": status})


def relation_assertions(asserted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variant, relation, status): each variant against the canonical one (variant 0) of its case.

    same-detection passes if both pass with equal readings; must-flip if both
    pass, the canonical has a secret and the variant has none. Review on either
    side is review; not measured on either side gives no row.
    """
    rows = asserted.where("status <> 'not-measured'").withColumn("reading", reading())
    base = rows.where("variant = 0").select(*keys, F.col("status").alias("b_status"), F.col("reading").alias("b_reading"), F.col("has_secret").alias("b_secret"))
    both = rows.where("variant > 0").join(base, keys)
    return both.select(*keys, "variant", "relation", relation_status(F.col("b_status"), F.col("b_reading"), F.col("b_secret")).alias("status"))


def reading() -> Column:
    """What a measurement says, as text."""
    return F.coalesce(F.col("span_outcomes"), F.col("flagged").cast("string"), F.lit(""))


def relation_status(b_status: Column, b_reading: Column, b_secret: Column) -> Column:
    """The status of a variant's relation to the canonical one, which has these."""
    review = (F.col("status") == "review-required") | (b_status == "review-required")
    passed = (F.col("status") == "pass") & (b_status == "pass")
    flip = b_secret & ~F.col("has_secret")
    holds = passed & F.when(F.col("relation") == "must-flip", flip).otherwise(F.col("reading") == b_reading)
    return F.when(review, "review-required").when(holds, "pass").otherwise("fail")


def differential(variants: DataFrame, findings: DataFrame, scanners: DataFrame, unmeasured: DataFrame, reference: str) -> DataFrame:
    """(case_id, peer, status, disagreement, classification_compared) of the reference scanner with every other on every case.

    Neither scanner may be incomplete; a case that either couldn't map has no row.
    Ranges meet range by range: two sets are equal if they have as many ranges as
    they share. No row holds a text's ranges.
    """
    classes = classify_ranges(findings)
    seen = classes.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.col("unmapped") | (F.size("families") == 0)).alias("unclassed"))
    of_reference = classes.where(F.col("scanner") == reference).select("case_id", "start_byte", "end_byte", F.col("families").alias("r_families"), F.col("unmapped").alias("r_unmapped"))
    of_peers = classes.where(F.col("scanner") != reference).withColumnRenamed("scanner", "peer")
    alike = (F.col("families") == F.col("r_families")) & (F.col("unmapped") == F.col("r_unmapped"))
    both = of_peers.join(of_reference, ["case_id", "start_byte", "end_byte"]).groupBy("case_id", "peer").agg(F.count("*").alias("shared"), F.sum(alike.cast("long")).alias("alike"))
    status = {name: scanners.where(F.col("scanner") == reference) if name == "r" else scanners.where(F.col("scanner") != reference) for name in "rp"}
    pairs = status["p"].select(F.col("scanner").alias("peer"), F.col("status").alias("p_status")).crossJoin(status["r"].select(F.col("status").alias("r_status")))
    rows = variants.select("case_id").crossJoin(pairs)
    missing = unmeasured.select("scanner", "case_id").distinct()
    rows = rows.join(missing.where(F.col("scanner") == reference).select("case_id", F.lit(True).alias("r_gone")), "case_id", "left")
    rows = rows.join(missing.select("case_id", F.col("scanner").alias("peer"), F.lit(True).alias("p_gone")), ["case_id", "peer"], "left")
    rows = rows.join(seen.where(F.col("scanner") == reference).select("case_id", *[F.col(c).alias(f"r_{c}") for c in ("n", "unclassed")]), "case_id", "left")
    rows = rows.join(seen.select("case_id", F.col("scanner").alias("peer"), *[F.col(c).alias(f"p_{c}") for c in ("n", "unclassed")]), ["case_id", "peer"], "left")
    rows = rows.join(both, ["case_id", "peer"], "left")
    complete = (F.col("r_status") == "complete") & (F.col("p_status") == "complete")
    rows = rows.where(~complete | (F.col("r_gone").isNull() & F.col("p_gone").isNull()))
    equal = F.col("r_n").eqNullSafe(F.col("p_n")) & (F.coalesce("shared", F.lit(0)) == F.coalesce("r_n", F.lit(0)))
    classifiable = equal & F.col("r_n").isNotNull() & ~F.coalesce("r_unclassed", F.lit(False)) & ~F.coalesce("p_unclassed", F.lit(False))
    disagreement = (
        F.when(~equal & F.col("p_n").isNull(), "reference-only")
        .when(~equal & F.col("r_n").isNull(), "peer-only")
        .when(~equal, "range-disagreement")
        .when(classifiable & (F.col("alike") < F.col("shared")), "classification-disagreement")
        .otherwise("none")
    )
    unsupported = (F.col("r_status") == "unsupported") | (F.col("p_status") == "unsupported")
    return rows.select(
        "case_id",
        "peer",
        F.when(complete, "complete").when(unsupported, "unsupported").otherwise("incomplete").alias("status"),
        F.when(complete, disagreement).alias("disagreement"),
        F.when(complete, classifiable).alias("classification_compared"),
    )


def review_queue(comparisons: DataFrame, pending: DataFrame) -> DataFrame:
    """(entry_id, kind, case_id, subject): disagreements and pending expectations, once each, under an id that doesn't hold the reference's version."""
    disagreements = comparisons.where("status = 'complete' and disagreement <> 'none'").select(F.lit("disagreement").alias("kind"), "case_id", F.concat_ws("/", "peer", "disagreement").alias("subject"))
    expectations = pending.select(F.lit("pending-expectation").alias("kind"), "case_id", F.col("kind").alias("subject"))
    rows = disagreements.unionByName(expectations).distinct()
    identity = F.to_json(F.struct(F.col("case_id").cast("string").alias("case"), "kind", "subject"))
    return rows.select(F.concat(F.lit("sha256:"), F.sha2(identity, 256)).alias("entry_id"), "kind", "case_id", "subject")


def review_state(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries by kind and what the ledger (entry_id, state, first_seen) says of them; entries that it lacks are unknown."""
    joined = queue.join(ledger, "entry_id", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    counts = [F.sum((F.col("state") == s).cast("long")).alias(s.replace("-", "_")) for s in ("open", "resolved", "not-assertable", "unknown")]
    return joined.groupBy("kind").agg(F.count("*").alias("entries"), *counts, F.min(F.when(F.col("state") == "open", F.col("first_seen"))).alias("oldest_open"))


FINDING = [*KEY, "start_byte", "end_byte", "family", "action"]


def whole_finding(findings: DataFrame) -> list[str]:
    """The columns that make a finding what it is: labels and mapping too, where there are any."""
    return [*FINDING, *[c for c in ("labels", "mapping") if c in findings.columns]]


def _replay_counts(findings: DataFrame, replays: DataFrame) -> DataFrame:
    """Each whole finding with how often the replays report it (least, most), in how many of them (seen), and how many there are."""
    n = replays.select("scanner", "replay").distinct().groupBy("scanner").agg(F.count("*").alias("replays"))
    whole = whole_finding(findings)
    counted = findings.groupBy(*whole, "replay").agg(F.count("*").alias("n"))
    return counted.groupBy(*whole).agg(F.count("*").alias("seen"), F.min("n").alias("least"), F.max("n").alias("most")).join(n, "scanner")


def replay_sets(findings: DataFrame, replays: DataFrame) -> DataFrame:
    """(scanner, divergent_cases): cases whose set of whole findings (range, family, action, labels and mapping) isn't the same in all replays.

    ``replays`` (scanner, replay) is the roster: a replay that found nothing is one too.
    """
    return _replay_counts(findings, replays).where("seen < replays").groupBy("scanner").agg(F.count_distinct("case_id").alias("divergent_cases"))


def replay_multisets(findings: DataFrame, replays: DataFrame) -> DataFrame:
    """(scanner, case_id) whose whole findings aren't reported equally often in every replay of the roster."""
    return _replay_counts(findings, replays).where("seen < replays or least < most").select(*KEY).distinct()


def mutation_cases(cases: DataFrame) -> DataFrame:
    """(case_id, twin): each positive with the first of its twins by id; positives without a twin are left out."""
    twins = cases.where("twin_of is not null").groupBy(F.col("twin_of").alias("case_id")).agg(F.min("case_id").alias("twin"))
    return cases.where("kind <> 'must-not-flag' and tier <> 'T0'").join(twins, "case_id").select("case_id", "twin")


METHODS = ("differential", "twin", "benign", "metamorphic", "mutation")


def methods_of(cases: DataFrame) -> Column:
    """The methods of a case, an array: by whether it is a twin and whether it holds no secret."""
    twin, control = F.col("twin_of").isNotNull(), F.col("kind") == "must-not-flag"
    if "expected" in cases.columns:
        control = F.coalesce(~F.exists("expected", lambda s: s["role"] == "secret"), F.lit(True))
    return F.array_compact(
        F.array(
            F.lit("differential"),
            F.when(twin, F.lit("twin")),
            F.when(~twin & control, F.lit("benign")),
            F.when(~twin, F.lit("metamorphic")),
            F.when(~twin, F.lit("mutation")),
        )
    )


def first_twins(cases: DataFrame) -> DataFrame:
    """(case_id, first_twin): the first twin by id of each case that has one."""
    return cases.where("twin_of is not null").groupBy(F.col("twin_of").alias("case_id")).agg(F.min("case_id").alias("first_twin"))


def benign_taxonomy() -> Column:
    return F.when(F.col("method") == "benign", F.when(F.col("tier") == "T0", "pending").otherwise(F.col("taxonomy")))


def method_cases(cases: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """(eval_id, method, case_id, seed_id, twin_id, taxonomy): the evaluation cases of each method.

    A twin's seed is its positive; a case that is no twin is benign if it holds no
    secret (``expected``; without that column, if it is a control), pending at T0; only cases that are no twins are transformed or mutated, a mutation
    with the first twin by id. Ids are <case>--<method>.
    """
    chosen = F.array(*[F.lit(m) for m in methods or METHODS])
    rows = cases.join(first_twins(cases), "case_id", "left").withColumn("method", F.explode(methods_of(cases)))
    method = F.col("method")
    return rows.where(F.array_contains(chosen, method)).select(
        F.concat_ws("--", "case_id", "method").alias("eval_id"),
        "method",
        "case_id",
        F.when(method == "twin", F.col("twin_of")).otherwise(F.col("case_id")).alias("seed_id"),
        F.when(method == "twin", F.col("case_id")).when(method == "mutation", F.col("first_twin")).alias("twin_id"),
        benign_taxonomy().alias("taxonomy"),
    )


def assertion_delta(counts: DataFrame, unstable: list[str], floors) -> DataFrame:
    """(group_key, counts, v10_total, total, causes): assertions of each group of the baseline stratum, and why the versions differ.

    ``counts`` has method, scanner, stratum and the status counts; a stratum
    a->b belongs to a's group.
    """
    group = F.regexp_replace(F.split("stratum", "->")[0], "^([^:]*):", "$1/")
    gone = F.when(F.col("not_measured") > 0, F.when(F.col("scanner").isin(*unstable), "unstable").otherwise("not-measured"))
    open_ = F.when((F.col("review_required") > 0) & (floors.of(F.col("method")) > 0), F.lit("unresolved"))
    names = ["pass", "fail", "review_required", "not_measured"]
    found = counts.withColumns({"group_key": group, "gone": gone, "open": open_}).groupBy("group_key").agg(
        *[F.sum(c).alias(c) for c in names], F.array_join(F.array_sort(F.array_union(F.collect_set("gone"), F.collect_set("open"))), ",").alias("causes")
    )
    v10 = F.col("pass") + F.col("fail") + F.col("review_required")
    return found.select("group_key", *names, v10.alias("v10_total"), (v10 + F.col("not_measured")).alias("total"), "causes")
