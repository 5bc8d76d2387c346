"""Whole runs: a corpus measurement and a method run, and their written artifacts."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.canonical import canonical_json, sha256_text
from spanforge.functions.numeric import Accounting
from spanforge.operators import accounting, evaluation, generation, measure, methods
from spanforge.sources import corpus
from spanforge.sources.artifact import write_artifact


@dataclass(frozen=True)
class RunConfig:
    """What decides a run's results; ``jobs`` doesn't and isn't in its hash."""

    scanners: tuple[str, ...]
    jobs: int = 1
    accounting: Accounting = Accounting()
    reference: str | None = None
    families: tuple[str, ...] | None = None

    def config_hash(self) -> str:
        return sha256_text(canonical_json(asdict(replace(self, jobs=1, scanners=tuple(sorted(self.scanners))))))


@dataclass(frozen=True)
class Run:
    """Tables of a run. ``cases`` is read by all others: persist or write it first."""

    cases: DataFrame
    groups: DataFrame
    families: DataFrame
    comparisons: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in (("cases", self.cases), ("groups", self.groups), ("families", self.families), ("comparisons", self.comparisons)) if v is not None}


def measurement_run(spark: SparkSession, corpus_path: str, observations_path: str, config: RunConfig, work: str, coverage: DataFrame | None = None) -> Run:
    """Validate, score and account the chosen scanners' observations; refuses an invalid corpus, one that isn't what its digest says, stale or unfit observations.

    The case results go to ``work`` as a table before accounting, so that they
    are made once. ``coverage`` (family, covers) as in ``control_measurements``.
    """
    corpus.refuse(corpus.digest_violations(spark, corpus_path))
    cases = corpus.read_corpus(spark, corpus_path)
    corpus.refuse(corpus.corpus_violations(cases))
    scanners, findings, unmeasured = corpus.read_observations(spark, observations_path)
    check_binding(cases, scanners)
    chosen = F.col("scanner").isin(*config.scanners)
    scanners, findings, unmeasured = scanners.where(chosen), findings.where(chosen), unmeasured.where(chosen)
    corpus.refuse(corpus.observation_violations(findings, unmeasured, cases))
    if config.families is not None:
        findings = measure.restrict_families(findings, list(config.families))
    found, missing = corpus.on_cases(findings, cases), corpus.on_cases(unmeasured, cases)
    roster = scanners.select("scanner", "status")
    facts = cases.select("case_id", "kind", "tier", "family", "group", "twin_of", "sibling")
    scored = measure.score_cases(facts, corpus.spans_of(cases).drop("env_reason"), found, roster, missing, coverage)
    scored.write.mode("overwrite").parquet(f"{work}/cases")
    results = spark.read.parquet(f"{work}/cases")
    compared = methods.differential(facts, found, roster, missing, config.reference) if config.reference else None
    return Run(results, accounting.account_groups(results, config.accounting), accounting.family_view(results), compared)


@dataclass(frozen=True)
class MethodRun:
    """Tables of a method run: variants with their attempts, readings, assertions, comparisons, the summaries and the review queue."""

    variants: DataFrame
    readings: DataFrame
    assertions: DataFrame
    comparisons: DataFrame
    review: DataFrame
    summaries: dict[str, DataFrame]
    resolution: DataFrame
    unresolved: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        named = {k: getattr(self, k) for k in ("variants", "readings", "assertions", "comparisons", "review", "resolution", "unresolved")}
        return named | {f"summary_{k}": v for k, v in self.summaries.items()}


def variant_plan(cases: DataFrame, contracts: DataFrame, work: str, method_names: list[str] | None = None, taxonomies: Iterable[str] | None = None) -> DataFrame:
    """Generate all variants into ``work``: what detectors are then shown.

    Cases that break a rule of their method are refused, controls of other
    ``taxonomies`` than the evidence file's among them, and two variants of one path.
    """
    spark = cases.sparkSession
    corpus.refuse(generation.plan_violations(cases, method_names, None if taxonomies is None else sorted(taxonomies)))
    generation.generate(cases, contracts, method_names).write.mode("overwrite").parquet(f"{work}/variants")
    variants = spark.read.parquet(f"{work}/variants")
    corpus.refuse(variants.where("path is not null").groupBy("path").agg(F.count("*").alias("variants")).where("variants > 1"))
    return variants


def method_run(variants: DataFrame, findings: DataFrame, scanners: DataFrame, unmeasured: DataFrame, config: RunConfig, work: str, coverage: DataFrame | None = None) -> MethodRun:
    """Evaluate the findings (scanner, case_id of a variant, range, family, action, emit_seq) recorded over the variants.

    Readings and assertions go to ``work`` as tables, as all else reads them.
    Comparisons are those of the differential cases with the reference scanner.
    """
    spark = variants.sparkSession
    evaluation.observe_variants(variants, findings, scanners, unmeasured, coverage).write.mode("overwrite").parquet(f"{work}/readings")
    readings = spark.read.parquet(f"{work}/readings")
    evaluation.variant_assertions(readings, scanners).write.mode("overwrite").parquet(f"{work}/assertions")
    assertions = spark.read.parquet(f"{work}/assertions")
    same = variants.where("method = 'differential' and status = 'generated'")
    compared = methods.differential(same, findings, scanners, unmeasured, config.reference or "")
    queue = methods.review_queue(compared, evaluation.pending_expectations(variants))
    found = evaluation.summaries(assertions, variants)
    resolution, unresolved = evaluation.resolved(found["by_method"], config.accounting)
    return MethodRun(variants, readings, assertions, compared, queue, found, resolution, unresolved)


def check_binding(cases: DataFrame, scanners: DataFrame) -> None:
    """Observations of another corpus are refused: both name the corpus by its digest."""
    mine = cases.select("corpus_digest").distinct()
    stale = scanners.join(mine, "corpus_digest", "left_anti").select("scanner", "corpus_digest")
    corpus.refuse(stale)
    double = scanners.groupBy("scanner").agg(F.count("*").alias("observations")).where("observations > 1")
    corpus.refuse(double)


def write_run(run: Run, path: str, config: RunConfig) -> dict:
    """Write each table sorted by its keys, and a manifest; returns the manifest. The same run gives the same digests."""
    keys = {"cases": ["scanner", "case_id"], "groups": ["scanner", "group_key"], "families": ["scanner", "family"], "comparisons": ["case_id", "peer"]}
    digests = {}
    for name, df in run.tables().items():
        df.repartitionByRange(*keys[name]).sortWithinPartitions(*keys[name]).write.mode("overwrite").parquet(f"{path}/{name}")
        written = df.sparkSession.read.parquet(f"{path}/{name}")
        row = F.xxhash64(F.to_json(F.struct(*sorted(written.columns))))
        n, a, b = written.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        digests[name] = {"rows": n, "digest": f"{a & (2**64 - 1):016x}{int(b) & (2**64 - 1):016x}"}
    manifest = {"config_hash": config.config_hash(), "tables": digests}
    spark = run.cases.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


RUN_KEYS = {"cases": ["scanner", "case_id"], "groups": ["scanner", "group_key"], "families": ["scanner", "family"], "comparisons": ["case_id", "peer"], "variants": ["eval_id", "number"], "readings": ["scanner", "eval_id"], "assertions": ["scanner", "eval_id"], "review": ["entry_id"]}


def commit_run(run: Run | MethodRun, path: str, config: RunConfig) -> dict:
    """Write a plain run or a method run as one artifact, in place of what was there; returns the manifest."""
    spark = next(iter(run.tables().values())).sparkSession
    tables = {name: (df, [k for k in RUN_KEYS.get(name, df.columns[:2]) if k in df.columns]) for name, df in run.tables().items()}
    return write_artifact(spark, path, tables, {"config_hash": config.config_hash(), "kind": "method-run" if isinstance(run, MethodRun) else "run"})


def commit_observations(scanners: DataFrame, findings: DataFrame, unmeasured: DataFrame, path: str, corpus_digest: str) -> dict:
    """Write an observation set as one artifact, bound to the corpus by its digest."""
    tables = {"scanners": (scanners, ["scanner"]), "findings": (findings, ["scanner", "start_byte"]), "unmeasured": (unmeasured, ["scanner"])}
    return write_artifact(scanners.sparkSession, path, tables, {"corpus_digest": corpus_digest, "kind": "observations"})


def reuse_decisions(current: DataFrame, recorded: DataFrame, fields: list[str]) -> DataFrame:
    """(scanner, decision, changed): whether a scanner's recorded observations still hold, field by field of its identity."""
    r = recorded.select(F.col("scanner").alias("r_scanner"), *[F.col(f).alias(f"r_{f}") for f in fields])
    both = current.join(r, F.col("scanner") == F.col("r_scanner"), "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    decision = F.when(F.col("r_scanner").isNull(), "run").when(F.size(changed) == 0, "reuse").otherwise("rerun")
    return both.select("scanner", decision.alias("decision"), F.when(F.col("r_scanner").isNotNull(), F.array_join(changed, ",")).otherwise("").alias("changed"))


def pin_violations(pins: DataFrame, provenance: DataFrame) -> DataFrame:
    """(scanner, component, reason) for pinned components (scanner, component, digest) that the provenance lacks or has with another digest."""
    p = provenance.select(F.col("scanner").alias("p_scanner"), F.col("component").alias("p_component"), F.col("digest").alias("p_digest"))
    joined = pins.join(p, (F.col("scanner") == F.col("p_scanner")) & (F.col("component") == F.col("p_component")), "left")
    reason = F.when(F.col("p_scanner").isNull(), "missing component").when(~F.col("digest").eqNullSafe(F.col("p_digest")), "digest differs")
    return joined.withColumn("reason", reason).where("reason is not null").select("scanner", "component", "reason")


def capabilities() -> dict:
    return {"outcomes": list(measure.OUTCOMES), "statuses": list(corpus.STATUSES), "kinds": list(corpus.KINDS), "tiers": list(corpus.TIERS), "methods": ["absolute", "differential", "metamorphic", "mutation"]}
