"""Accounting of case results: group counts, published rates, twins, selections and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.numeric import UNCOVERED, WITHHELD, Accounting, proportion, ratio
from spanforge.sources.store import materialize

SUMS = ("spans", "exact", "covered", "overbroad", "partial", "miss", "secret_bytes", "leaked_bytes", "collateral_bytes", "envelope_spans", "envelope_bytes", "fp")


def group_key(kind: Column, tier: Column) -> Column:
    return F.when(tier == "T0", "pending/T0").otherwise(F.concat_ws("/", kind, tier))


def lenient() -> Column:
    return (F.col("partial") + F.col("miss")) == 0


def strict() -> Column:
    return (F.col("overbroad") + F.col("partial") + F.col("miss")) == 0


def measured(results: DataFrame) -> DataFrame:
    return results.where("measurement_type <> 'not-measured'")


def twin_pairs(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_key, pairs, discriminated_lenient, discriminated_strict, co_detected) of scored twins under their positive's group."""
    twins = results.where("twin_of is not null and tier <> 'T0'").select(*keys, F.col("twin_of").alias("case_id"), F.col("flagged").alias("t_flagged"), F.col("co_detected").alias("t_co"))
    positives = results.where("measurement_type = 'positive'")
    pairs = positives.join(twins, [*keys, "case_id"])
    calm = ~F.col("t_flagged")
    return pairs.groupBy(*keys, group_key(F.col("kind"), F.col("tier")).alias("group_key")).agg(
        F.count("*").alias("pairs"),
        F.sum((lenient() & calm).cast("long")).alias("discriminated_lenient"),
        F.sum((strict() & calm).cast("long")).alias("discriminated_strict"),
        F.sum(F.col("t_co").cast("long")).alias("co_detected_pairs"),
    )


def group_counts(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of each group; not-measured rows are in none. Columns of other populations are 0."""
    keys = keys or ["scanner"]
    rows = measured(results).withColumn("group_key", group_key(F.col("kind"), F.col("tier")))
    control = F.col("measurement_type") == "control"
    counts = rows.groupBy(*keys, "group_key").agg(
        F.min(F.when(F.col("measurement_type") == "pending", "pending").when(control, "control").otherwise("positive")).alias("population"),
        F.count("*").alias("files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS if c != "fp"],
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.sum(F.coalesce(F.col("flagged").cast("long"), F.lit(0))).alias("flagged_files"),
        F.coalesce(F.sum(F.when(control, F.col("findings")).otherwise(F.col("fp"))), F.lit(0)).alias("fp"),
        F.sum((control & ~F.col("flagged")).cast("long")).alias("tn"),
    )
    twins = twin_pairs(rows.drop("group_key"), keys)
    names = ["pairs", "discriminated_lenient", "discriminated_strict", "co_detected_pairs"]
    out = counts.join(twins, [*keys, "group_key"], "left").fillna(0, names)
    return out.withColumns(
        {
            "tn": F.coalesce("tn", F.lit(0)),
            "tp": F.col("exact"),
            "fn": F.col("spans") - F.col("exact"),
            "leaked_spans": F.col("partial") + F.col("miss"),
        }
    )


def pending_by_kind(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """T0 cases by the kind that their evidence proposes."""
    return measured(results).where("tier = 'T0'").groupBy(*(keys or ["scanner"]), "kind").agg(F.count("*").alias("pending_files"))


def account_groups(results: DataFrame, config: Accounting = Accounting(), keys: list[str] | None = None, pending: DataFrame | None = None) -> DataFrame:
    """Group counts with their published figures, each a struct(point, bound, n, withheld).

    A positive group whose measurable share is under its floor has its rates
    withheld; twins under the coverage floor have theirs withheld for coverage.
    Every tier of a kind is charged with all pending cases of that kind: ``pending``
    (keys, kind, pending_files), or else the T0 cases among the results.
    """
    keys = keys or ["scanner"]
    counts = group_counts(results, keys).withColumn("kind", F.split("group_key", "/")[0])
    pending = pending_by_kind(results, keys) if pending is None else pending
    rows = counts.join(pending, [*keys, "kind"], "left").fillna(0, ["pending_files"])
    rows = rows.withColumn("pending_files", F.when(F.col("population") == "positive", F.col("pending_files")).otherwise(0))
    c = F.col
    positive, control = c("population") == "positive", c("population") == "control"
    share = c("files") / (c("files") + c("pending_files"))
    measurable = share >= config.measurable_share_floor.of(c("kind"))
    covered = (c("files") > 0) & (c("pairs") / c("files") >= config.twin_coverage_floor.of(c("kind")))
    rate = proportion(c("discriminated_strict"), c("pairs"), False, config)
    held = lambda reason: F.struct(F.lit(None).cast("double").alias("point"), F.lit(None).cast("double").alias("bound"), F.lit(None).cast("long").alias("n"), F.lit(reason).alias("withheld"))
    figures = {
        "measurable_share": (positive, proportion(c("files"), c("files") + c("pending_files"), False, config)),
        "leaked_span_rate": (positive, proportion(c("leaked_spans"), c("spans"), True, config, allowed=measurable)),
        "leaked_byte_rate": (positive, proportion(c("leaked_bytes"), c("secret_bytes"), True, config, n=c("spans"), allowed=measurable)),
        "collateral_ratio": (positive, ratio(c("collateral_bytes"), c("secret_bytes"), config, n=c("spans"), allowed=measurable)),
        "twin_coverage": (positive, proportion(c("pairs"), c("files"), False, config)),
        "twin_rate": (positive & (c("pairs") > 0), F.when(~measurable, held(WITHHELD)).when(~covered, held(UNCOVERED)).otherwise(rate)),
        "false_alarm_rate": (control, proportion(c("flagged_files"), c("files"), True, config)),
        "mean_findings_per_flagged": (control, ratio(c("findings"), c("flagged_files"), config, n=c("files"))),
    }
    return rows.select(*keys, "group_key", "population", "files", "pending_files", "pairs", *[F.when(when, figure).alias(name) for name, (when, figure) in figures.items()])


def account_selections(results: DataFrame, assignments: DataFrame, config: Accounting = Accounting()) -> DataFrame:
    """Groups of each target's cases: ``assignments`` (case_id, target); results have a suite.

    For a group of a target, the pool is what the suites that hold the group
    have of: the group's own cases, the target's T0 cases, and twins of the own
    cases. The target is one more grouping key, so all targets are one pass;
    ``overall`` takes every assigned case.
    """
    every = assignments.select("case_id", F.lit("overall").alias("target")).distinct()
    chosen = assignments.select("case_id", "target").distinct().unionByName(every)
    rows = measured(results).withColumn("key", group_key(F.col("kind"), F.col("tier")))
    mine = rows.join(chosen, "case_id")
    suites = mine.select("scanner", "target", F.col("key").alias("sel_key"), "suite").distinct()
    own = mine.withColumn("sel_key", F.col("key"))
    mates = mine.where("measurement_type = 'positive'").select("scanner", "target", F.col("key").alias("sel_key"), F.col("case_id").alias("twin_of"))
    assigned = chosen.withColumn("assigned", F.lit(True))
    twins = rows.where("twin_of is not null").join(mates, ["scanner", "twin_of"]).join(suites, ["scanner", "target", "sel_key", "suite"], "left_semi").join(assigned, ["case_id", "target"], "left")
    keys = ["scanner", "target", "sel_key"]
    columns = [*keys, "key", "case_id", "twin_of", "kind", "tier", "measurement_type", "assigned", *SUMS, "findings", "flagged", "co_detected"]
    pool = own.withColumn("assigned", F.lit(True)).select(columns).unionByName(twins.where("assigned is null or key <> sel_key").select(columns))
    # Counts, pairs and pending cases each read the pool: a table, so that its joins are planned and run once.
    pool = materialize(pool, "pool")
    # The target's T0 cases are only counted: by suite, and then for each group that the suite holds. Other T0 cases are twins of no target's.
    waiting = mine.where("tier = 'T0'").groupBy("scanner", "target", "suite", "kind").agg(F.count("*").alias("n")).join(suites, ["scanner", "target", "suite"])
    waiting = waiting.select(*keys, "kind", "n").unionByName(pool.where("tier = 'T0' and assigned is null").select(*keys, "kind", F.lit(1).cast("long").alias("n")))
    pending = waiting.groupBy(*keys, "kind").agg(F.sum("n").alias("pending_files"))
    return account_groups(pool, config, keys, pending).where("group_key = sel_key").drop("sel_key")


def twin_probe(families: DataFrame, twins: DataFrame, results: DataFrame, unprobeable: DataFrame) -> DataFrame:
    """(family, status, twins, pairs, discriminated) of one scanner's results.

    ``families`` (family), ``twins`` (case_id, twin_of, family), ``unprobeable``
    (family). A family with twins that is recorded as unprobeable is an error.
    """
    r = results.select("case_id", "tier", "kind", "measurement_type", "flagged", strict().alias("strict"))
    t = twins.join(r.select(F.col("case_id").alias("t_id"), F.col("tier").alias("t_tier"), F.col("flagged").alias("t_flagged")), F.col("case_id") == F.col("t_id"), "left")
    p = r.select(F.col("case_id").alias("p_id"), F.col("tier").alias("p_tier"), F.col("kind").alias("p_kind"), F.col("measurement_type").alias("p_type"), "strict")
    t = t.join(p, F.col("twin_of") == F.col("p_id"), "left")
    pair = F.coalesce(F.col("t_id").isNotNull() & (F.col("t_tier") != "T0") & (F.col("p_tier") != "T0") & (F.col("p_kind") != "must-not-flag") & (F.col("p_type") == "positive"), F.lit(False))
    good = pair & F.col("strict") & ~F.coalesce("t_flagged", F.lit(False))
    counted = t.groupBy("family").agg(F.count("*").alias("twins"), F.sum(pair.cast("long")).alias("pairs"), F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias("discriminated"))
    rows = families.join(counted, "family", "left").join(unprobeable.select("family", F.lit(True).alias("recorded")), "family", "left").fillna(0, ["twins", "pairs", "discriminated"])
    recorded = F.coalesce("recorded", F.lit(False))
    status = (
        F.when((F.col("twins") > 0) & recorded, F.raise_error(F.concat(F.lit("unprobeable family with twins: "), F.col("family"))).cast("string"))
        .when((F.col("twins") == 0) & recorded, "un-probeable")
        .when(F.col("twins") == 0, "unrecorded")
        .when(F.col("pairs") == 0, "not-measured")
        .when(F.col("discriminated") == F.col("pairs"), "discriminated")
        .otherwise("not-discriminated")
    )
    return rows.select("family", status.alias("status"), "twins", "pairs", "discriminated")


def family_view(results: DataFrame) -> DataFrame:
    """Case results by scanner and family."""
    c = F.col
    return results.groupBy("scanner", F.coalesce("family", F.lit("(no-family)")).alias("family")).agg(
        F.count("*").alias("cases"),
        *[F.sum((c("measurement_type") == t).cast("long")).alias(t.replace("-", "_")) for t in ("positive", "control", "pending", "not-measured")],
        F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"),
        F.coalesce(F.sum(c("partial") + c("miss")), F.lit(0)).alias("leaked_spans"),
        F.coalesce(F.sum("leaked_bytes"), F.lit(0)).alias("leaked_bytes"),
        F.sum(F.coalesce(c("flagged").cast("long"), F.lit(0))).alias("flagged"),
    )


STATUSES = ("pass", "fail", "review-required", "not-measured")


def status_counts(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Assertions of each key by status."""
    return assertions.groupBy(*keys).agg(*[F.sum((F.col("status") == s).cast("long")).alias(s.replace("-", "_")) for s in STATUSES])


def resolution(counts: DataFrame, config: Accounting = Accounting()) -> DataFrame:
    """Totals, resolved and unresolved assertions, and the resolved rate."""
    resolved = F.col("pass") + F.col("fail")
    total = resolved + F.col("review_required") + F.col("not_measured")
    return counts.withColumns({"total": total, "resolved": resolved, "unresolved": total - resolved}).withColumn("resolved_rate", proportion(F.col("resolved"), F.col("total"), False, config))


def unresolved_strata(counts: DataFrame, config: Accounting = Accounting()) -> DataFrame:
    """(stratum_key): strata under their method's floor, T0 strata excepted; and <method>/* where a method with a floor resolved nothing.

    ``counts`` has method, scanner, stratum and assertion beside the status counts.
    """
    rows = counts.withColumns({"resolved": F.col("pass") + F.col("fail"), "total": sum((F.col(s.replace("-", "_")) for s in STATUSES), F.lit(0))})
    floor = config.resolved_rate_floor.of(F.col("method"))
    below = rows.where(~F.col("stratum").contains(":T0") & (F.col("total") > 0) & (F.col("resolved") / F.col("total") < floor))
    below = below.select(F.concat_ws("/", "method", "scanner", "stratum", "assertion").alias("stratum_key"))
    methods = rows.groupBy("method").agg(F.sum("resolved").alias("resolved"), F.sum("total").alias("total"))
    none = methods.where((F.col("total") > 0) & (F.col("resolved") == 0) & (floor > 0)).select(F.concat("method", F.lit("/*")).alias("stratum_key"))
    return below.unionByName(none)


def version_delta(results: DataFrame, config: Accounting = Accounting()) -> DataFrame:
    """Groups whose first-version figures differ from today's, with causes: rates once published are withheld, and twins counted leniently are counted strictly."""
    now = account_groups(results, config).where("population = 'positive'").select("scanner", "group_key", "leaked_span_rate", "twin_rate")
    counts = group_counts(results).where("population = 'positive'").select("scanner", "group_key", "leaked_spans", "spans", "pairs", "discriminated_lenient", "discriminated_strict")
    both = now.join(counts, ["scanner", "group_key"])
    causes = F.array_compact(
        F.array(
            F.when(F.col("leaked_span_rate.withheld").isNotNull(), F.lit("leaked-span-rate-withheld")),
            F.when(F.col("twin_rate.withheld").isNotNull(), F.lit("twin-rate-withheld")),
            F.when(F.col("discriminated_lenient") != F.col("discriminated_strict"), F.lit("overbroad-no-longer-discriminates")),
        )
    )
    return both.select(
        "scanner",
        "group_key",
        F.try_divide("leaked_spans", "spans").alias("old_leaked_span_rate"),
        F.col("leaked_span_rate.point").alias("leaked_span_rate"),
        F.try_divide("discriminated_lenient", "pairs").alias("old_twin_rate"),
        F.col("twin_rate.point").alias("twin_rate"),
        F.array_join(causes, ",").alias("causes"),
    )


def scope_accounting(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings by the disposition of their labels. ``scope`` (label, disposition).

    A finding with a family is mapped; else the best of its labels' dispositions
    counts: credential, not-credential, ambiguous; labels outside the table are ambiguous.
    All dispositions are returned, those without findings with 0.
    """
    rank = F.create_map(*[x for k, v in (("credential", 1), ("not-credential", 2), ("ambiguous", 3)) for x in (F.lit(k), F.lit(v))])
    labels = findings.withColumn("finding_id", F.struct("scanner", "case_id", "start_byte", "end_byte")).select("finding_id", "scanner", "family", F.explode_outer("labels").alias("label"))
    joined = labels.join(scope, "label", "left").withColumn("r", F.coalesce(rank[F.col("disposition")], F.lit(3)))
    per = joined.groupBy("finding_id", "scanner").agg(F.when(F.max("family").isNotNull(), 0).otherwise(F.min("r")).alias("r"))
    names = F.array(*[F.lit(x) for x in ("mapped", "credential", "not-credential", "ambiguous")])
    counted = per.groupBy("scanner", "r").agg(F.count("*").alias("findings"))
    zero = per.select("scanner").distinct().select("scanner", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    return zero.join(counted, ["scanner", "r"], "left").select("scanner", F.element_at(names, F.col("r") + 1).alias("disposition"), F.coalesce("findings", F.lit(0)).alias("findings"))


DISPOSITIONS = ("mapped-credential", "credential-related-unmapped", "out-of-scope", "ambiguous", "native-label-unavailable", "unrecognized-label")


def _labelled(findings: DataFrame, table: DataFrame) -> DataFrame:
    """Each label of each finding with its class: 0 mapped, 1 credential-related and unresolved, 2 no credential, 3 ambiguous, null not reviewed."""
    kind = F.when(F.col("disposition") == "mapped", 0).when((F.col("disposition") == "unresolved") & (F.col("scope") == "ambiguous"), 3).when(F.col("disposition") == "unresolved", 1).when(F.col("disposition") == "not-credential", 2)
    labels = findings.select("finding_id", "scanner", "family", F.explode("labels").alias("label"))
    reviewed = table.select("label", "scope", F.col("status").alias("disposition"))
    return labels.join(reviewed, "label", "left").withColumn("class", kind)


def classify_findings(findings: DataFrame, table: DataFrame) -> DataFrame:
    """(finding_id, scanner, n_labels, disposition, conflicting) of findings (finding_id, scanner, family, labels) under reviewed labels (label, scope, status).

    A finding with a family is mapped, whatever its labels say. Labels that
    disagree, or some reviewed and some not, are conflicting, and then
    ambiguous; so is a mapped label on a finding without a family.
    """
    classes = _labelled(findings, table).groupBy("finding_id").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.max(F.col("class").isNull()).alias("unknown"))
    rows = findings.select("finding_id", "scanner", "family", F.size("labels").alias("n_labels")).join(classes, "finding_id", "left")
    found = F.coalesce("classes", F.array().cast("array<int>"))
    conflicting = (F.size(found) > 1) | (F.coalesce("unknown", F.lit(False)) & (F.size(found) > 0))
    disposition = (
        F.when(F.col("family").isNotNull(), "mapped-credential")
        .when(F.col("n_labels") == 0, "native-label-unavailable")
        .when(F.size(found) == 0, "unrecognized-label")
        .when(conflicting | F.array_contains(found, 3) | F.array_contains(found, 0), "ambiguous")
        .when(F.array_contains(found, 1), "credential-related-unmapped")
        .otherwise("out-of-scope")
    )
    return rows.select("finding_id", "scanner", "n_labels", disposition.alias("disposition"), conflicting.alias("conflicting"))


def scope_totals(findings: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by scanner: findings, one count for each of DISPOSITIONS, multi_label, conflicting; by scanner and label: findings, with_family, scope, status)."""
    rows = classify_findings(findings, table)
    counts = [F.sum((F.col("disposition") == d).cast("long")).alias(d.replace("-", "_")) for d in DISPOSITIONS]
    totals = rows.groupBy("scanner").agg(F.count("*").alias("findings"), *counts, F.sum((F.col("n_labels") > 1).cast("long")).alias("multi_label"), F.sum(F.col("conflicting").cast("long")).alias("conflicting"))
    labels = _labelled(findings, table).groupBy("scanner", "label", "scope", F.col("disposition").alias("status"))
    return totals, labels.agg(F.count("*").alias("findings"), F.count("family").alias("with_family"))
