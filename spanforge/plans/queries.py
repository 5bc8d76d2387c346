"""Registered queries of the measurement operators, and the SQL that each is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import canonical, codecs, intervals, numeric, text
from spanforge.operators import accounting, facts, matching, measure, methods, perf, representation, variants
from spanforge.plans import runs
from spanforge.plans.standin import CORPUS_SQL, SCORED_SQL, corpus, table
from spanforge.sources import artifact, reports
from spanforge.sources.store import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = numeric.Accounting()
QUAD = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


def query(sql: str | None = None, scored: bool = False, corpus_sql: bool = False):
    """Register a query under its function's name, with SQL after the common tables that it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = "WITH " + CORPUS_SQL + ("," + SCORED_SQL if scored else "") if scored or corpus_sql else ""
            joint = ", " if head and sql.lstrip().startswith("WITH ") else " "
            ORACLE_SQL[f.__name__] = head + joint + (sql.lstrip()[5:] if joint == ", " else sql)
        return f

    return add


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case results as a table: accounting reads them several times."""
    return materialize(score_cases(spark, sf_dir), "case-results")


def _complete(c) -> DataFrame:
    return c.scanners.where("status = 'complete'")


# ---------------------------------------------------------------- lattice and scoring


@query("SELECT scanner, outcome, count(*) AS spans, CAST(sum(end_byte - start_byte) AS BIGINT) AS secret_bytes FROM outcomes GROUP BY scanner, outcome", scored=True)
def span_outcome(spark, sf_dir):
    c = corpus(spark, sf_dir)
    found = measure.span_outcomes(c.spans, measure.dedupe_findings(c.findings), _complete(c))
    return found.groupBy("scanner", "outcome").agg(F.count("*").alias("spans"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("secret_bytes"))


@query("SELECT scanner, case_id, start_byte, end_byte FROM islands", scored=True)
def interval_union(spark, sf_dir):
    return intervals.merge_ranges(corpus(spark, sf_dir).findings, measure.KEY)


def _suite_texts(c):
    """Findings and spans of a suite as those of one long text, each case sixty bytes after the one before: hot keys with a third of all rows."""
    suites = c.cases.select("case_id", "suite")
    moved = [(F.col(b) + 60 * F.col("case_id")).alias(b) for b in ("start_byte", "end_byte")]
    findings = c.findings.join(suites, "case_id").select("scanner", F.col("suite").alias("case_id"), *moved)
    envelope = [(F.col(b) + 60 * F.col("case_id")).alias(b) for b in ("env_start", "env_end")]
    spans = c.spans.join(suites, "case_id").select(F.col("suite").alias("case_id"), (4 * F.col("case_id") + F.col("span_idx")).alias("span_idx"), "role", *moved, *envelope)
    return findings, spans


_SUITE_FINDINGS = "SELECT f.scanner, c.suite, f.start_byte + 60 * f.case_id AS s, f.end_byte + 60 * f.case_id AS e FROM findings f JOIN cases c ON f.case_id = c.case_id"


@query(
    f"""WITH f AS ({_SUITE_FINDINGS}),
       o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY scanner, suite ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM f),
       g AS (SELECT *, sum(opens) OVER (PARTITION BY scanner, suite ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
       SELECT scanner, suite, min(s) AS start_byte, max(e) AS end_byte, count(*) AS n FROM g GROUP BY scanner, suite, island""",
    corpus_sql=True,
)
def suite_union(spark, sf_dir):
    findings, _ = _suite_texts(corpus(spark, sf_dir))
    return intervals.merge_ranges(findings, measure.KEY, counted=True).withColumnRenamed("case_id", "suite")


@query(
    f"""WITH f AS ({_SUITE_FINDINGS}),
       p AS (SELECT c.suite, s.case_id, s.span_idx, s.start_byte + 60 * s.case_id AS s, s.end_byte + 60 * s.case_id AS e,
               coalesce(s.env_start, s.start_byte) + 60 * s.case_id AS a, coalesce(s.env_end, s.end_byte) + 60 * s.case_id AS z FROM spans s JOIN cases c ON s.case_id = c.case_id WHERE s.role = 'secret'),
       j AS (SELECT k.scanner, p.suite, p.case_id, p.span_idx, coalesce(bool_or(f.s = p.s AND f.e = p.e), FALSE) AS exact, coalesce(bool_or(f.s <= p.s AND f.e >= p.e AND f.s >= p.a AND f.e <= p.z), FALSE) AS covered,
               coalesce(bool_or(f.s <= p.s AND f.e >= p.e), FALSE) AS holds, count(f.s) > 0 AS touched
             FROM p CROSS JOIN (SELECT scanner FROM scanners WHERE status = 'complete') k LEFT JOIN f ON f.scanner = k.scanner AND f.suite = p.suite AND f.s < p.e AND p.s < f.e GROUP BY ALL)
       SELECT scanner, suite, CASE WHEN exact THEN 'EXACT' WHEN covered THEN 'COVERED' WHEN holds THEN 'OVERBROAD' WHEN touched THEN 'PARTIAL' ELSE 'MISS' END AS outcome, count(*) AS spans FROM j GROUP BY ALL""",
    corpus_sql=True,
)
def suite_outcomes(spark, sf_dir):
    c = corpus(spark, sf_dir)
    findings, spans = _suite_texts(c)
    found = measure.span_outcomes(spans, findings, _complete(c))
    return found.groupBy("scanner", F.col("case_id").alias("suite"), "outcome").agg(F.count("*").alias("spans"))


# ---------------------------------------------------------------- places of reported values

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_KEY_HEAD, _KEY_FOOT = "-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----"


@query(
    f"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '{EMAIL}', 0) AS email, strlen(text) AS n, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents),
       e AS (SELECT *, base64(encode(email)) AS once, hex(encode(base64(encode(email)))) AS twice, base64(encode('key of ' || email)) AS body, strlen(left(text, strpos(text, email) - 1)) AS spot FROM d WHERE email <> ''),
       p AS (SELECT doc_id, 'plain' AS rule, spot AS start_byte, spot + strlen(email) AS end_byte, NULL AS bound, NULL AS layers FROM e
         UNION ALL SELECT doc_id, 'escaped', spot, spot + strlen(email), NULL, NULL FROM e
         UNION ALL SELECT doc_id, 'decoded', n + 5, n + 5 + strlen(once), 'source-segment', 1 FROM e
         UNION ALL SELECT doc_id, 'decoded-twice', n + 10 + strlen(once), n + 10 + strlen(once) + strlen(twice), 'source-segment', 2 FROM e
         UNION ALL SELECT doc_id, 'private-key', n + 11 + strlen(once) + strlen(twice), n + 11 + strlen(once) + strlen(twice) + {len(_KEY_HEAD) + len(_KEY_FOOT)} + strlen(body), 'source-block', 1 FROM e)
       SELECT doc_id, rule, start_byte, end_byte, bound, CAST(layers AS INT) AS layers FROM p"""
)
def placed_reports(spark, sf_dir):
    """Five reports of each document's first address: as it is, escaped, and in decoded text that is put after the document."""
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", EMAIL, 0).alias("email")).where("email <> ''")
    coded = lambda t: F.regexp_replace(F.base64(F.encode(t, "UTF-8")), "[\r\n]", "")
    once, body = coded(F.col("email")), coded(F.concat(F.lit("key of "), F.col("email")))
    twice = F.hex(F.encode(once, "UTF-8"))
    lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1
    path = F.col("doc_id").cast("string").alias("path")
    cases = materialize(found.select(path, F.concat("text", F.lit("\nb64 "), once, F.lit("\nhex "), twice, F.lit("\n" + _KEY_HEAD), body, F.lit(_KEY_FOOT)).alias("content")), "texts")
    none = F.array().cast("array<string>")
    tagged = lambda depth, *codecs: F.array(*[F.lit(f"decoded:{c}") for c in codecs], F.lit(f"decode-depth:{depth}"))
    rows = {
        "plain": (F.col("email"), F.lit(None), none),
        "escaped": (F.replace("email", F.lit("@"), F.lit("%40")), F.lit(None), none),
        "decoded": (F.col("email"), lines + 1, tagged(1, "base64")),
        "decoded-twice": (F.col("email"), lines + 2, tagged(2, "base64", "hex")),
        "private-key": (F.concat(F.lit(_KEY_HEAD + "key of "), F.col("email"), F.lit(_KEY_FOOT)), lines + 3, tagged(1, "base64")),
    }
    reported = F.array(*[F.struct(F.lit(rule).alias("rule"), v.alias("value"), n.cast("long").alias("line"), t.alias("tags")) for rule, (v, n, t) in rows.items()])
    asked = found.select(path, F.explode(reported).alias("r")).select("path", F.col("r.rule").alias("raw"), "r.*")
    placed, _ = reports.locate_values(asked, cases, "s", decoded=True)
    return placed.select(F.col("path").cast("bigint").alias("doc_id"), F.col("family").alias("rule"), "start_byte", "end_byte", F.col("mapping.bound").alias("bound"), F.col("mapping.layers").alias("layers"))


@query("SELECT scanner, case_id, collateral_bytes AS outside FROM outside", scored=True)
def bytes_outside(spark, sf_dir):
    c = corpus(spark, sf_dir)
    accepted = c.spans.crossJoin(_complete(c).select("scanner")).select(
        *measure.KEY, intervals.acceptable_start().alias("start_byte"), intervals.acceptable_end().alias("end_byte")
    )
    return intervals.bytes_outside(c.findings, accepted, measure.KEY)


@query("SELECT scanner, case_id, span_outcomes, spans, leaked_bytes, collateral_bytes, fp FROM positives", scored=True)
def row_measurement(spark, sf_dir):
    c = corpus(spark, sf_dir)
    found = measure.positive_measurements(c.spans, measure.dedupe_findings(c.findings), _complete(c))
    return found.select("scanner", "case_id", "span_outcomes", "spans", "leaked_bytes", "collateral_bytes", "fp")


@query(
    """WITH h AS (SELECT k.case_id, c.scanner, count(f.case_id) AS findings FROM cases k CROSS JOIN complete c
         LEFT JOIN dd f ON f.scanner = c.scanner AND f.case_id = k.case_id WHERE k.kind = 'must-not-flag' GROUP BY k.case_id, c.scanner)
       SELECT h.scanner, h.case_id, h.findings, h.findings > 0 AS flagged, a.action_counts FROM h LEFT JOIN acts a ON a.scanner = h.scanner AND a.case_id = h.case_id""",
    scored=True,
)
def control_measurement(spark, sf_dir):
    c = corpus(spark, sf_dir)
    found = measure.control_measurements(c.cases.where("kind = 'must-not-flag'").select("case_id"), measure.dedupe_findings(c.findings), _complete(c))
    return found.select("scanner", "case_id", "findings", "flagged", "action_counts")


@query(
    """WITH h AS (SELECT c.scanner, k.case_id, f.case_id AS hit, coalesce(f.family <> k.family OR f.family = 'fam-0', FALSE) AS other FROM cases k CROSS JOIN complete c
         LEFT JOIN dd f ON f.scanner = c.scanner AND f.case_id = k.case_id WHERE k.kind = 'must-not-flag' AND k.twin_of IS NOT NULL)
       SELECT scanner, case_id, count(hit) AS findings, count(*) FILTER (other) < count(hit) AS flagged, count(*) FILTER (other) > 0 AS co_detected FROM h GROUP BY scanner, case_id""",
    scored=True,
)
def twin_scope(spark, sf_dir):
    c = corpus(spark, sf_dir)
    controls = c.cases.where("kind = 'must-not-flag' and twin_of is not null").select("case_id", F.col("family").alias("scope"), F.lit("fam-0").alias("sibling"))
    return measure.control_measurements(controls, measure.dedupe_findings(c.findings), _complete(c)).select("scanner", "case_id", "findings", "flagged", "co_detected")


@query("SELECT scanner, case_id, start_byte, end_byte, family, action, emit_seq, reports FROM dd", scored=True)
def dedupe_last_wins(spark, sf_dir):
    return measure.dedupe_findings(corpus(spark, sf_dir).findings)


@query("SELECT scanner, case_id, start_byte, end_byte, family, action FROM dd", scored=True)
def last_finding(spark, sf_dir):
    return measure.last_wins(corpus(spark, sf_dir).findings).select("scanner", "case_id", "start_byte", "end_byte", "family", "action")


@query(
    """SELECT scanner, case_id, start_byte, end_byte, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS families, bool_or(family IS NULL) AS unmapped
       FROM findings GROUP BY scanner, case_id, start_byte, end_byte""",
    corpus_sql=True,
)
def classify_ranges(spark, sf_dir):
    return measure.classify_ranges(corpus(spark, sf_dir).findings).withColumn("families", F.array_join("families", ","))


@query("SELECT * FROM scored", scored=True)
def score_cases(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return measure.score_cases(c.cases, c.spans, c.findings, c.scanners, c.unmeasured)


@query("SELECT scanner, measurement_type, count(*) AS cases FROM scored GROUP BY scanner, measurement_type", scored=True)
def unmeasured_cases(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("scanner", "measurement_type").agg(F.count("*").alias("cases"))


@query("SELECT scanner, CASE WHEN family IN ('fam-1', 'fam-2') THEN family END AS family, count(*) AS findings FROM findings GROUP BY ALL", corpus_sql=True)
def family_allowlist(spark, sf_dir):
    return measure.restrict_families(corpus(spark, sf_dir).findings, ["fam-1", "fam-2"]).groupBy("scanner", "family").agg(F.count("*").alias("findings"))


# ---------------------------------------------------------------- accounting

COUNTS = "scanner, group_key, population, files, spans, exact, covered, overbroad, partial, miss, secret_bytes, leaked_bytes, collateral_bytes, envelope_spans, envelope_bytes, findings, flagged_files, fp, tn, tp, fn, leaked_spans, pairs, discriminated_lenient, discriminated_strict, co_detected_pairs"


@query(f"SELECT {COUNTS} FROM counts", scored=True)
def group_counts(spark, sf_dir):
    return accounting.group_counts(_scored(spark, sf_dir)).select(*COUNTS.split(", "))


@query("SELECT * FROM pend", scored=True)
def pending_by_kind(spark, sf_dir):
    return accounting.pending_by_kind(_scored(spark, sf_dir))


@query("SELECT scanner, group_key, pairs, discriminated_lenient, discriminated_strict, co_detected_pairs FROM twins", scored=True)
def twin_pairs(spark, sf_dir):
    return accounting.twin_pairs(accounting.measured(_scored(spark, sf_dir)), ["scanner"])


def _wilson_sql(p: str, n: str, upper: bool) -> str:
    z = CONFIG.interval_z
    z2 = f"CAST({z} AS DOUBLE) * CAST({z} AS DOUBLE)"
    scale = f"(CAST(1.0 AS DOUBLE) + ({z2}) / {n})"
    raw = f"(({p} + ({z2}) / (CAST(2.0 AS DOUBLE) * {n})) / {scale} {'+' if upper else '-'} (CAST({z} AS DOUBLE) / {scale}) * sqrt(({p} * (CAST(1.0 AS DOUBLE) - {p})) / {n} + ({z2}) / (CAST(4.0 AS DOUBLE) * {n} * {n})))"
    return f"CASE WHEN {p} <= 1 THEN round(least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), {raw})), {CONFIG.interval_precision}) END"


def _figure_sql(name: str, num: str, den: str, upper: bool | None, when: str, n: str | None = None, allowed: str = "TRUE") -> str:
    guard, point = n or den, f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE))"
    shown = f"({when}) AND {den} > 0 AND {guard} > 0 AND ({allowed}) AND {guard} >= {CONFIG.min_denominator}"
    bound = f"CASE WHEN {shown} THEN {_wilson_sql(point, f'CAST({guard} AS DOUBLE)', upper)} END" if upper is not None else "CAST(NULL AS DOUBLE)"
    return f"""CASE WHEN {shown} THEN round({point}, {CONFIG.interval_precision}) END AS {name}_point, {bound} AS {name}_bound,
        CASE WHEN {shown} THEN {den if upper is None else guard} END AS {name}_n,
        CASE WHEN ({when}) AND NOT ({allowed}) THEN 'insufficient-evidence' WHEN ({when}) AND {den} > 0 AND {guard} > 0 AND {guard} < {CONFIG.min_denominator} THEN 'insufficient-evidence' END AS {name}_withheld"""


def _flat(df: DataFrame, figures: list[str], rest: list[str]) -> DataFrame:
    return df.select(*rest, *[F.col(f"{f}.{part}").alias(f"{f}_{part}") for f in figures for part in ("point", "bound", "n", "withheld")])


_POS, _CTL = "population = 'positive'", "population = 'control'"
_MEASURABLE = "files / (files + pending_files) >= CASE WHEN kind = 'policy' THEN 0.0 ELSE 0.7 END"
ACCOUNTED_SQL = f"""acc AS (SELECT c.*, CASE WHEN {_POS.replace('population', 'c.population')} THEN coalesce(p.pending_files, 0) ELSE 0 END AS pending_files
        FROM counts c LEFT JOIN pend p ON p.scanner = c.scanner AND p.kind = c.kind)"""


@query(
    f"""WITH {ACCOUNTED_SQL} SELECT scanner, group_key, population, files, pending_files,
        {_figure_sql('measurable_share', 'files', '(files + pending_files)', False, _POS)},
        {_figure_sql('leaked_span_rate', 'leaked_spans', 'spans', True, _POS, allowed=_MEASURABLE)},
        {_figure_sql('leaked_byte_rate', 'leaked_bytes', 'secret_bytes', True, _POS, n='spans', allowed=_MEASURABLE)},
        {_figure_sql('false_alarm_rate', 'flagged_files', 'files', True, _CTL)} FROM acc""",
    scored=True,
)
def published_rates(spark, sf_dir):
    accounted = accounting.account_groups(_scored(spark, sf_dir), CONFIG)
    return _flat(accounted, ["measurable_share", "leaked_span_rate", "leaked_byte_rate", "false_alarm_rate"], ["scanner", "group_key", "population", "files", "pending_files"])


@query(
    f"""WITH {ACCOUNTED_SQL} SELECT scanner, group_key, {_figure_sql('collateral_ratio', 'collateral_bytes', 'secret_bytes', None, _POS, n='spans', allowed=_MEASURABLE)},
        {_figure_sql('mean_findings_per_flagged', 'findings', 'flagged_files', None, _CTL, n='files')} FROM acc""",
    scored=True,
)
def ratio_rates(spark, sf_dir):
    return _flat(accounting.account_groups(_scored(spark, sf_dir), CONFIG), ["collateral_ratio", "mean_findings_per_flagged"], ["scanner", "group_key"])


_COVERED = "pairs / files >= CASE WHEN kind = 'policy' THEN 0.0 ELSE 0.5 END"


@query(
    f"""WITH {ACCOUNTED_SQL}, f AS (SELECT scanner, group_key, pairs, kind, files, pending_files, population,
        {_figure_sql('twin_coverage', 'pairs', 'files', False, _POS)}, {_figure_sql('twin_rate', 'discriminated_strict', 'pairs', False, _POS + ' AND pairs > 0 AND ' + _MEASURABLE + ' AND ' + _COVERED)} FROM acc)
        SELECT scanner, group_key, twin_coverage_point, twin_coverage_bound, twin_coverage_n, twin_coverage_withheld, twin_rate_point, twin_rate_bound, twin_rate_n,
        CASE WHEN {_POS} AND pairs > 0 AND NOT ({_MEASURABLE}) THEN 'insufficient-evidence' WHEN {_POS} AND pairs > 0 AND NOT ({_COVERED}) THEN 'insufficient-coverage' ELSE twin_rate_withheld END AS twin_rate_withheld FROM f""",
    scored=True,
)
def twin_rates(spark, sf_dir):
    return _flat(accounting.account_groups(_scored(spark, sf_dir), CONFIG), ["twin_coverage", "twin_rate"], ["scanner", "group_key"])


@query(
    f"""SELECT l_suppkey, sum_ok AS numerator, n AS denominator, round(sum_ok / n, 6) AS point,
        {_wilson_sql('(CAST(sum_ok AS DOUBLE) / CAST(n AS DOUBLE))', 'CAST(n AS DOUBLE)', True)} AS upper_bound, {_wilson_sql('(CAST(sum_ok AS DOUBLE) / CAST(n AS DOUBLE))', 'CAST(n AS DOUBLE)', False)} AS lower_bound
        FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS sum_ok, count(*) AS n FROM lineitem GROUP BY l_suppkey)"""
)
def wilson_bounds(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("numerator"), F.count("*").alias("denominator"))
    point = F.col("numerator").cast("double") / F.col("denominator").cast("double")
    end = lambda upper: numeric.wilson(point, F.col("denominator"), upper, CONFIG.interval_z, CONFIG.interval_precision)
    return items.select("l_suppkey", "numerator", "denominator", numeric.round_to_fixed(point, 6).alias("point"), end(True).alias("upper_bound"), end(False).alias("lower_bound"))


_ASSIGN = "SELECT case_id, 'target-' || (case_id % 7) AS target FROM cases WHERE case_id % 9 > 0 UNION ALL SELECT case_id, 'target-' || (case_id % 5 + 7) FROM cases WHERE case_id % 3 = 0"


@query(
    f"""WITH assign AS ({_ASSIGN}), chosen AS (SELECT DISTINCT * FROM assign UNION SELECT DISTINCT case_id, 'overall' FROM assign),
        mine AS (SELECT k.*, c.target FROM keyed k JOIN chosen c ON c.case_id = k.case_id),
        suites AS (SELECT DISTINCT scanner, target, group_key AS sel_key, suite FROM mine),
        pool AS (SELECT DISTINCT * FROM (
            SELECT scanner, target, group_key AS sel_key, case_id FROM mine
            UNION ALL SELECT m.scanner, m.target, s.sel_key, m.case_id FROM mine m JOIN suites s ON s.scanner = m.scanner AND s.target = m.target AND s.suite = m.suite WHERE m.tier = 'T0'
            UNION ALL SELECT t.scanner, m.target, m.group_key, t.case_id FROM keyed t JOIN mine m ON m.scanner = t.scanner AND m.case_id = t.twin_of AND m.measurement_type = 'positive'
                JOIN suites s ON s.scanner = t.scanner AND s.target = m.target AND s.sel_key = m.group_key AND s.suite = t.suite)),
        p AS (SELECT p.target, p.sel_key, k.* FROM pool p JOIN keyed k ON k.scanner = p.scanner AND k.case_id = p.case_id),
        own AS (SELECT scanner, target, sel_key, measurement_type AS population, count(*) AS files FROM p WHERE group_key = sel_key GROUP BY ALL),
        pn AS (SELECT scanner, target, sel_key, kind, count(*) AS pending FROM p WHERE tier = 'T0' GROUP BY ALL),
        pr AS (SELECT a.scanner, a.target, a.sel_key, count(*) AS pairs FROM p a JOIN p t ON t.scanner = a.scanner AND t.target = a.target AND t.sel_key = a.sel_key AND t.twin_of = a.case_id AND t.tier <> 'T0'
            WHERE a.measurement_type = 'positive' AND a.group_key = a.sel_key GROUP BY ALL)
        SELECT o.scanner, o.target, o.sel_key AS group_key, o.population, o.files, CASE WHEN o.population = 'positive' THEN coalesce(pn.pending, 0) ELSE 0 END AS pending_files, coalesce(pr.pairs, 0) AS pairs
        FROM own o LEFT JOIN pn ON pn.scanner = o.scanner AND pn.target = o.target AND pn.sel_key = o.sel_key AND pn.kind = split_part(o.sel_key, '/', 1)
        LEFT JOIN pr ON pr.scanner = o.scanner AND pr.target = o.target AND pr.sel_key = o.sel_key""",
    scored=True,
)
def by_target(spark, sf_dir):
    cases = corpus(spark, sf_dir).cases
    first = cases.where("case_id % 9 > 0").selectExpr("case_id", "concat('target-', case_id % 7) as target")
    second = cases.where("case_id % 3 = 0").selectExpr("case_id", "concat('target-', case_id % 5 + 7) as target")
    accounted = accounting.account_selections(_scored(spark, sf_dir), first.unionByName(second), CONFIG)
    return accounted.select("scanner", "target", "group_key", "population", "files", "pending_files", "pairs")


@query(
    """WITH fam AS (SELECT 'fam-' || i AS family FROM range(8) t(i)), unp AS (SELECT 'fam-7' AS family),
        r AS (SELECT * FROM scored WHERE scanner = 'scanner-0'),
        t AS (SELECT c.family, x.case_id IS NOT NULL AND p.case_id IS NOT NULL AND x.tier <> 'T0' AND p.tier <> 'T0' AND p.kind <> 'must-not-flag' AND p.measurement_type = 'positive' AS pair,
            p.overbroad + p.partial + p.miss = 0 AND NOT coalesce(x.flagged, FALSE) AS good
            FROM cases c LEFT JOIN r x ON x.case_id = c.case_id LEFT JOIN r p ON p.case_id = c.twin_of WHERE c.twin_of IS NOT NULL),
        n AS (SELECT family, count(*) AS twins, count(*) FILTER (pair) AS pairs, count(*) FILTER (pair AND good) AS discriminated FROM t GROUP BY family)
        SELECT f.family, CASE WHEN n.twins IS NULL THEN CASE WHEN u.family IS NOT NULL THEN 'un-probeable' ELSE 'unrecorded' END
            WHEN pairs = 0 THEN 'not-measured' WHEN discriminated = pairs THEN 'discriminated' ELSE 'not-discriminated' END AS status,
            coalesce(twins, 0) AS twins, coalesce(pairs, 0) AS pairs, coalesce(discriminated, 0) AS discriminated
        FROM fam f LEFT JOIN n ON n.family = f.family LEFT JOIN unp u ON u.family = f.family""",
    scored=True,
)
def twin_probe(spark, sf_dir):
    families = spark.range(8).selectExpr("concat('fam-', id) as family")
    twins = corpus(spark, sf_dir).cases.where("twin_of is not null").select("case_id", "twin_of", "family")
    return accounting.twin_probe(families, twins, _scored(spark, sf_dir).where("scanner = 'scanner-0'"), families.where("family = 'fam-7'"))


@query(
    """SELECT scanner, coalesce(family, '(no-family)') AS family, count(*) AS cases, count(*) FILTER (measurement_type = 'positive') AS positive, count(*) FILTER (measurement_type = 'control') AS control,
        count(*) FILTER (measurement_type = 'pending') AS pending, count(*) FILTER (measurement_type = 'not-measured') AS not_measured, CAST(coalesce(sum(spans), 0) AS BIGINT) AS spans,
        CAST(coalesce(sum(partial + miss), 0) AS BIGINT) AS leaked_spans, CAST(coalesce(sum(leaked_bytes), 0) AS BIGINT) AS leaked_bytes, count(*) FILTER (flagged) AS flagged FROM scored GROUP BY ALL""",
    scored=True,
)
def family_view(spark, sf_dir):
    return accounting.family_view(_scored(spark, sf_dir))


@query(
    f"""WITH {ACCOUNTED_SQL} SELECT scanner, group_key, leaked_spans / spans AS old_leaked_span_rate,
        CASE WHEN {_MEASURABLE} AND spans >= 5 THEN round(leaked_spans / spans, 6) END AS leaked_span_rate,
        CASE WHEN pairs > 0 THEN discriminated_lenient / pairs END AS old_twin_rate,
        CASE WHEN pairs >= 5 AND {_MEASURABLE} AND {_COVERED} THEN round(discriminated_strict / pairs, 6) END AS twin_rate,
        concat_ws(',', CASE WHEN NOT ({_MEASURABLE}) OR spans < 5 THEN 'leaked-span-rate-withheld' END,
            CASE WHEN pairs > 0 AND (NOT ({_MEASURABLE}) OR NOT ({_COVERED}) OR pairs < 5) THEN 'twin-rate-withheld' END,
            CASE WHEN discriminated_lenient <> discriminated_strict THEN 'overbroad-no-longer-discriminates' END) AS causes
        FROM acc WHERE {_POS}""",
    scored=True,
)
def version_delta(spark, sf_dir):
    return accounting.version_delta(_scored(spark, sf_dir), CONFIG)


# ---------------------------------------------------------------- methods

ASSERTED_SQL = """asserted AS (SELECT *, kind <> 'must-not-flag' AS has_secret, case_id // 4 AS seed, case_id % 4 AS variant,
        CASE WHEN measurement_type = 'not-measured' OR case_id % 11 = 0 OR tier = 'T0' THEN 'absolute' WHEN kind <> 'must-not-flag' THEN 'present-within-envelope' ELSE 'absent' END AS assertion,
        CASE WHEN measurement_type = 'not-measured' THEN 'not-measured' WHEN case_id % 11 = 0 OR tier = 'T0' THEN 'review-required'
            WHEN CASE WHEN kind <> 'must-not-flag' THEN overbroad + partial + miss = 0 AND collateral_bytes = 0 ELSE NOT flagged END THEN 'pass' ELSE 'fail' END AS status FROM scored)"""


def _asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumns(
        {
            "has_secret": F.col("kind") != "must-not-flag",
            "strategy": F.when(F.col("case_id") % 11 == 0, "review-required").otherwise("derived"),
            "seed": F.floor(F.col("case_id") / 4),
            "variant": F.col("case_id") % 4,
            "relation": F.when(F.col("case_id") % 4 == 3, "must-flip").otherwise("same-detection"),
        }
    )
    return methods.absolute_assertions(rows)


@query(f"WITH {ASSERTED_SQL} SELECT scanner, case_id, assertion, status FROM asserted", scored=True)
def absolute_assertions(spark, sf_dir):
    return _asserted(spark, sf_dir).select("scanner", "case_id", "assertion", "status")


@query(
    f"""WITH {ASSERTED_SQL}, r AS MATERIALIZED (SELECT scanner, seed, variant, status, has_secret, coalesce(span_outcomes, CAST(flagged AS VARCHAR), '') AS reading FROM asserted WHERE status <> 'not-measured'),
        v AS (SELECT *, max(CASE WHEN variant = 0 THEN 1 ELSE 0 END) OVER w AS based, max(CASE WHEN variant = 0 THEN status END) OVER w AS b_status,
            max(CASE WHEN variant = 0 THEN reading END) OVER w AS b_reading, bool_or(variant = 0 AND has_secret) OVER w AS b_secret FROM r WINDOW w AS (PARTITION BY scanner, seed))
        SELECT scanner, seed, variant, CASE WHEN variant = 3 THEN 'must-flip' ELSE 'same-detection' END AS relation,
        CASE WHEN status = 'review-required' OR b_status = 'review-required' THEN 'review-required'
            WHEN status = 'pass' AND b_status = 'pass' AND CASE WHEN variant = 3 THEN b_secret AND NOT has_secret ELSE reading = b_reading END THEN 'pass' ELSE 'fail' END AS status
        FROM v WHERE variant > 0 AND based = 1""",
    scored=True,
)
def relation_assertions(spark, sf_dir):
    return methods.relation_assertions(_asserted(spark, sf_dir), ["scanner", "seed"])


METHOD_SQL = "CASE case_id % 3 WHEN 0 THEN 'metamorphic' WHEN 1 THEN 'mutation' ELSE 'differential' END"
STATUS_SQL = "count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'review-required') AS review_required, count(*) FILTER (status = 'not-measured') AS not_measured"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*[F.lit(m) for m in ("metamorphic", "mutation", "differential")]), (F.col("case_id") % 3 + 1).cast("int"))
    rows = _asserted(spark, sf_dir).withColumns({"method": method, "stratum": F.concat_ws(":", "kind", "tier")})
    return accounting.status_counts(rows, ["method", "scanner", "stratum", "assertion"])


@query(f"WITH {ASSERTED_SQL} SELECT {METHOD_SQL} AS method, scanner, kind || ':' || tier AS stratum, assertion, {STATUS_SQL} FROM asserted GROUP BY ALL", scored=True)
def assertion_summary(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query(
    f"""WITH {ASSERTED_SQL}, s AS (SELECT {METHOD_SQL} AS method, scanner, kind || ':' || tier AS stratum, assertion, {STATUS_SQL} FROM asserted GROUP BY ALL),
        t AS (SELECT *, pass + fail + review_required + not_measured AS total, pass + fail AS resolved FROM s)
        SELECT method, scanner, stratum, assertion, pass, fail, review_required, not_measured, total, resolved, total - resolved AS unresolved, {_figure_sql('resolved_rate', 'resolved', 'total', False, 'TRUE')} FROM t""",
    scored=True,
)
def resolution(spark, sf_dir):
    found = accounting.resolution(_statuses(spark, sf_dir), CONFIG)
    return _flat(found, ["resolved_rate"], ["method", "scanner", "stratum", "assertion", "pass", "fail", "review_required", "not_measured", "total", "resolved", "unresolved"])


@query(
    f"""WITH {ASSERTED_SQL}, s AS (SELECT {METHOD_SQL} AS method, scanner, kind || ':' || tier AS stratum, assertion, {STATUS_SQL} FROM asserted GROUP BY ALL),
        t AS (SELECT *, pass + fail + review_required + not_measured AS total, pass + fail AS resolved, CASE WHEN method = 'differential' THEN 0.0 ELSE 0.9 END AS f FROM s)
        SELECT method || '/' || scanner || '/' || stratum || '/' || assertion AS stratum_key FROM t WHERE stratum NOT LIKE '%:T0%' AND total > 0 AND resolved / total < f
        UNION ALL SELECT method || '/*' FROM t GROUP BY method HAVING sum(total) > 0 AND sum(resolved) = 0 AND max(f) > 0""",
    scored=True,
)
def unresolved(spark, sf_dir):
    return accounting.unresolved_strata(_statuses(spark, sf_dir), CONFIG)


DIFFERENTIAL_SQL = """classes AS (SELECT scanner, case_id, start_byte AS s, end_byte AS e, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS f, bool_or(family IS NULL) AS u FROM findings GROUP BY ALL),
        seen AS (SELECT scanner, case_id, string_agg(s || '-' || e, ';' ORDER BY s, e) AS ranges, string_agg(s || '-' || e || '=' || f, ';' ORDER BY s, e) AS classes, bool_or(u OR f = '') AS unclassed FROM classes GROUP BY ALL),
        pairs AS (SELECT k.case_id, p.scanner AS peer, p.status AS p_status, r.status AS r_status FROM cases k CROSS JOIN scanners p CROSS JOIN scanners r WHERE r.scanner = 'scanner-0' AND p.scanner <> 'scanner-0'),
        joined AS (SELECT x.*, a.ranges AS ra, b.ranges AS rb, a.classes AS ca, b.classes AS cb, coalesce(a.unclassed, FALSE) OR coalesce(b.unclassed, FALSE) AS unclassed,
            u.case_id IS NOT NULL AS gone FROM pairs x LEFT JOIN seen a ON a.scanner = 'scanner-0' AND a.case_id = x.case_id LEFT JOIN seen b ON b.scanner = x.peer AND b.case_id = x.case_id
            LEFT JOIN unmeasured u ON u.scanner = x.peer AND u.case_id = x.case_id),
        diffs AS (SELECT case_id, peer, CASE WHEN p_status = 'complete' THEN 'complete' ELSE 'incomplete' END AS status,
            CASE WHEN p_status = 'complete' THEN CASE WHEN ra IS DISTINCT FROM rb THEN CASE WHEN rb IS NULL THEN 'reference-only' WHEN ra IS NULL THEN 'peer-only' ELSE 'range-disagreement' END
                WHEN ra IS NOT NULL AND NOT unclassed AND ca <> cb THEN 'classification-disagreement' ELSE 'none' END END AS disagreement,
            CASE WHEN p_status = 'complete' THEN ra IS NOT NULL AND ra IS NOT DISTINCT FROM rb AND NOT unclassed END AS classification_compared
            FROM joined WHERE NOT (p_status = 'complete' AND gone))"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return methods.differential(c.cases, c.findings, c.scanners, c.unmeasured, "scanner-0")


@query(f"WITH {DIFFERENTIAL_SQL} SELECT * FROM diffs", corpus_sql=True)
def differential(spark, sf_dir):
    return _differences(spark, sf_dir)


@query(
    f"""WITH {DIFFERENTIAL_SQL}, q AS (SELECT DISTINCT 'disagreement' AS kind, case_id, peer || '/' || disagreement AS subject FROM diffs WHERE status = 'complete' AND disagreement <> 'none'
            UNION SELECT DISTINCT 'pending-expectation', case_id, kind FROM cases WHERE tier = 'T0'),
        l AS (SELECT *, CASE WHEN case_id % 5 = 0 THEN 'resolved' WHEN case_id % 5 = 1 THEN 'not-assertable' WHEN case_id % 5 = 2 THEN 'open' ELSE 'unknown' END AS state FROM q)
        SELECT kind, count(*) AS entries, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'not-assertable') AS not_assertable,
        count(*) FILTER (state = 'unknown') AS unknown, min(CASE WHEN state = 'open' THEN 'run-' || (case_id % 13) END) AS oldest_open FROM l GROUP BY kind""",
    corpus_sql=True,
)
def review_state(spark, sf_dir):
    queue = methods.review_queue(_differences(spark, sf_dir), corpus(spark, sf_dir).cases.where("tier = 'T0'"))
    ledger = queue.where("case_id % 5 < 3").selectExpr("entry_id", "element_at(array('resolved', 'not-assertable', 'open'), cast(case_id % 5 as int) + 1) as state", "concat('run-', case_id % 13) as first_seen")
    return methods.review_state(queue, ledger)


def _replays(spark: SparkSession, c) -> DataFrame:
    return _complete(c).select("scanner", F.explode(F.array(F.lit(0), F.lit(1))).alias("replay"))


@query(
    """WITH f AS (SELECT DISTINCT scanner, case_id, start_byte, end_byte, family, action, replay FROM findings),
        g AS (SELECT scanner, case_id, start_byte, end_byte, family, action, count(*) AS k FROM f GROUP BY ALL)
        SELECT scanner, count(DISTINCT case_id) AS divergent_cases FROM g WHERE k < 2 GROUP BY scanner""",
    corpus_sql=True,
)
def replay_sets(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return methods.replay_sets(c.findings, _replays(spark, c))


@query(
    """WITH c AS (SELECT scanner, case_id, start_byte, end_byte, family, action, count(*) FILTER (replay = 0) AS a, count(*) FILTER (replay = 1) AS b FROM findings GROUP BY ALL)
        SELECT DISTINCT scanner, case_id FROM c WHERE a <> b""",
    corpus_sql=True,
)
def replay_multisets(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return methods.replay_multisets(c.findings, _replays(spark, c))


@query("SELECT c.case_id, min(t.case_id) AS twin FROM cases c JOIN cases t ON t.twin_of = c.case_id WHERE c.kind <> 'must-not-flag' AND c.tier <> 'T0' GROUP BY c.case_id", corpus_sql=True)
def mutation_cases(spark, sf_dir):
    return methods.mutation_cases(corpus(spark, sf_dir).cases)


@query(
    """WITH k AS (SELECT *, kind || '-taxonomy' AS taxonomy FROM cases), f AS (SELECT twin_of, min(case_id) AS first_twin FROM cases WHERE twin_of IS NOT NULL GROUP BY twin_of),
        m AS (SELECT k.*, 'differential' AS method FROM k UNION ALL SELECT k.*, 'twin' FROM k WHERE twin_of IS NOT NULL UNION ALL SELECT k.*, 'benign' FROM k WHERE twin_of IS NULL AND kind = 'must-not-flag'
            UNION ALL SELECT k.*, x FROM k, (VALUES ('metamorphic'), ('mutation')) v(x) WHERE twin_of IS NULL)
        SELECT m.case_id || '--' || method AS eval_id, method, m.case_id, CASE WHEN method = 'twin' THEN m.twin_of ELSE m.case_id END AS seed_id,
        CASE method WHEN 'twin' THEN m.case_id WHEN 'mutation' THEN f.first_twin END AS twin_id, CASE WHEN method = 'benign' THEN CASE WHEN tier = 'T0' THEN 'pending' ELSE taxonomy END END AS taxonomy
        FROM m LEFT JOIN f ON f.twin_of = m.case_id""",
    corpus_sql=True,
)
def method_cases(spark, sf_dir):
    return methods.method_cases(corpus(spark, sf_dir).cases.withColumn("taxonomy", F.concat("kind", F.lit("-taxonomy"))))


@query(
    f"""WITH {ASSERTED_SQL}, s AS (SELECT {METHOD_SQL} AS method, scanner, kind || ':' || tier AS stratum, assertion, {STATUS_SQL} FROM asserted GROUP BY ALL),
        c AS (SELECT replace(stratum, ':', '/') AS group_key, pass, fail, review_required, not_measured, unnest([CASE WHEN review_required > 0 AND method <> 'differential' THEN 'unresolved' END,
            CASE WHEN not_measured > 0 THEN CASE WHEN scanner = 'scanner-3' THEN 'unstable' ELSE 'not-measured' END END]) AS cause, unnest([1, 0]) AS one FROM s)
        SELECT group_key, CAST(sum(pass * one) AS BIGINT) AS pass, CAST(sum(fail * one) AS BIGINT) AS fail, CAST(sum(review_required * one) AS BIGINT) AS review_required, CAST(sum(not_measured * one) AS BIGINT) AS not_measured,
        CAST(sum((pass + fail + review_required) * one) AS BIGINT) AS v10_total, CAST(sum((pass + fail + review_required + not_measured) * one) AS BIGINT) AS total, coalesce(string_agg(DISTINCT cause, ',' ORDER BY cause), '') AS causes
        FROM c GROUP BY group_key""",
    scored=True,
)
def assertion_delta(spark, sf_dir):
    return methods.assertion_delta(_statuses(spark, sf_dir), ["scanner-3"], CONFIG.resolved_rate_floor)


# ---------------------------------------------------------------- variants


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as case_id", "concat(case o_orderkey % 3 when 0 then 'ключ=' when 1 then 'key: \"' else 'k=' end, 'tok_', md5(cast(o_orderkey as string)), '\\nnext') as content",
        "cast(case o_orderkey % 3 when 0 then 9 when 1 then 6 else 2 end as bigint) as start_byte", "cast(case o_orderkey % 3 when 0 then 45 when 1 then 42 else 38 end as bigint) as end_byte",
    )


TOKENS_SQL = """tokens AS (SELECT o_orderkey AS case_id, CASE o_orderkey % 3 WHEN 0 THEN 'ключ=' WHEN 1 THEN 'key: "' ELSE 'k=' END AS head, 'tok_' || md5(CAST(o_orderkey AS VARCHAR)) AS v, chr(10) || 'next' AS tail,
        CASE o_orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 6 ELSE 2 END AS s FROM orders)"""


@query(
    f"""WITH {TOKENS_SQL}, ops(operator, p, q, n, ok) AS (VALUES ('context.unicode-prefix', '# 🔑 密钥 café' || chr(10), '', 20, ''), ('context.indent', '    ', '', 4, ''),
            ('context.json', '{{"value":"', '"}}', 10, '"'), ('context.quote', '"', '"', 1, '"'), ('context.single-quote', '''', '''', 1, '''nl'), ('context.yaml', 'value: ''', '''' || chr(10), 8, '''nl'), ('context.markdown', '`', '`', 1, '`nl')),
        j AS (SELECT *, ok = '' AS supported FROM tokens CROSS JOIN ops)
        SELECT case_id, operator, supported, CASE WHEN supported THEN p || head || v || tail || q END AS content, CASE WHEN supported THEN CAST(s + n AS BIGINT) END AS start_byte,
        CASE WHEN supported THEN CAST(s + 36 + n AS BIGINT) END AS end_byte FROM j"""
)
def context_variants(spark, sf_dir):
    return variants.context_variants(_tokens(spark, sf_dir))


@query(f"WITH {TOKENS_SQL} SELECT case_id, TRUE AS supported, head || v || chr(13) || tail AS content, CAST(s AS BIGINT) AS start_byte, CAST(s + 36 AS BIGINT) AS end_byte FROM tokens")
def crlf_variants(spark, sf_dir):
    return variants.crlf_variants(_tokens(spark, sf_dir))


@query(
    f"""WITH {TOKENS_SQL}, c AS (SELECT *, CAST('0x' || substr(sha256('{{"seed":"' || case_id || '","operator":"lexical.prefix-change"}}'), 1, 12) AS BIGINT) % 25 AS choice FROM tokens),
        e AS (SELECT *, 'lexical.length-minus-one' AS operator, substr(v, 1, 35) AS value FROM c UNION ALL SELECT *, 'lexical.length-plus-one', v || 'A' FROM c
            UNION ALL SELECT *, 'lexical.replace-last', substr(v, 1, 35) || 'A' FROM c UNION ALL SELECT *, 'lexical.invalid-alphabet', substr(v, 1, 35) || '!' FROM c
            UNION ALL SELECT *, 'lexical.prefix-change', substr('ABCDEFGHIJKLMNOPQRSUVWXYZ', CAST(choice + 1 AS INT), 1) || substr(v, 2) FROM c)
        SELECT case_id, operator, value, head || value || tail AS content, CAST(s AS BIGINT) AS start_byte, CAST(s + strlen(value) AS BIGINT) AS end_byte,
        CASE WHEN regexp_matches(value, '^[a-z]+_[0-9a-f]+$') THEN 'derived' ELSE 'review-required' END AS strategy FROM e"""
)
def mutation_variants(spark, sf_dir):
    return variants.lexical_variants(_tokens(spark, sf_dir), "^[a-z]+_[0-9a-f]+$")


@query(
    """WITH v AS (SELECT o_orderkey AS case_id, string_split(CASE WHEN o_orderkey % 5 = 0 THEN 'single' ELSE 'a.b' || o_orderkey || '.c.d' END, '.') AS parts FROM orders),
        i AS (SELECT *, 1 + CAST('0x' || substr(sha256('{"seed":"' || case_id || '","operator":"structural.remove-segment"}'), 1, 12) AS BIGINT) % (len(parts) - 1) AS index FROM v WHERE len(parts) >= 2)
        SELECT case_id, index, array_to_string(list_concat(parts[1:index], parts[index + 2:]), '.') AS value FROM i"""
)
def segment_variants(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").selectExpr("o_orderkey as case_id", "case when o_orderkey % 5 = 0 then 'single' else concat('a.b', o_orderkey, '.c.d') end as value")
    return variants.segment_variants(cases, ".")


@query("""SELECT doc_id, CAST('0x' || substr(sha256('{"seed":"' || doc_id || '","operator":"' || source || '"}'), 1, 12) AS BIGINT) % 25 AS choice FROM documents""")
def seeded_choice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", canonical.seeded_choice(F.col("doc_id").cast("string"), F.col("source"), F.lit(25)).alias("choice"))


# ---------------------------------------------------------------- text, codecs and labels

LOCATED_SQL = f"""d AS (SELECT doc_id, regexp_extract_all(text, '{QUAD}') AS hits, string_split_regex(text, '{QUAD}') AS gaps FROM documents),
        u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM d),
        p AS (SELECT doc_id, i, hits[i] AS hit, gaps[1:i] AS g, CAST(list_sum(list_transform(gaps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS start_byte FROM u)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(QUAD))
    return docs.select("doc_id", "text", F.posexplode(text.regex_byte_spans(F.col("text"), QUAD)).alias("idx", "span"))


@query(f"WITH {LOCATED_SQL} SELECT doc_id, start_byte, start_byte + strlen(hit) AS end_byte FROM p")
def locate_spans(spark, sf_dir):
    return _located(spark, sf_dir).select("doc_id", "span.start_byte", "span.end_byte")


@query(f"WITH {LOCATED_SQL} SELECT doc_id, start_byte, 1 + CAST(list_sum(list_transform(g, lambda x: length(x) - length(replace(x, chr(10), '')))) AS BIGINT) AS line FROM p")
def line_numbers(spark, sf_dir):
    return _located(spark, sf_dir).select("doc_id", "span.start_byte", text.line_of(F.col("text"), F.col("span.start_byte")).cast("long").alias("line"))


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey % 3 AS value, emit_seq, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY emit_seq) AS rank
            FROM (SELECT *, CAST(floor(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS emit_seq FROM lineitem WHERE l_linenumber % 2 = 0)),
        o AS (SELECT l_orderkey, l_partkey % 3 AS value, CAST(floor(l_extendedprice * 100) AS BIGINT) AS start_byte, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY CAST(floor(l_extendedprice * 100) AS BIGINT)) AS rank FROM lineitem WHERE l_linenumber % 2 = 1)
        SELECT r.l_orderkey, r.value, r.emit_seq, CAST(r.rank AS INT) AS rank, o.start_byte FROM r LEFT JOIN o ON o.l_orderkey = r.l_orderkey AND o.value = r.value AND o.rank = r.rank"""
)
def claims_rank(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumns({"value": F.col("l_partkey") % 3, "price": F.floor(F.col("l_extendedprice") * 100)})
    reports = items.where("l_linenumber % 2 = 0").select("l_orderkey", "value", (F.col("price") * 10 + F.col("l_linenumber")).alias("emit_seq"))
    return text.claims(reports, items.where("l_linenumber % 2 = 1").select("l_orderkey", "value", F.col("price").alias("start_byte")), ["l_orderkey", "value"])


HEX_SQL = "CASE o_orderkey % 4 WHEN 0 THEN md5(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN upper(md5(CAST(o_orderkey AS VARCHAR))) WHEN 2 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 31) ELSE md5(CAST(o_orderkey AS VARCHAR)) || 'g0' END"


@query(
    f"""WITH h AS (SELECT o_orderkey, {HEX_SQL} AS v FROM orders), k AS (SELECT *, regexp_full_match(v, '([0-9a-fA-F][0-9a-fA-F])+') AS ok, regexp_matches(v, '[a-f]') AS l, regexp_matches(v, '[A-F]') AS u FROM h)
        SELECT o_orderkey, CASE WHEN ok AND NOT u THEN lower(v) END AS lower_hex, CASE WHEN ok AND NOT l THEN upper(v) END AS upper_hex, CASE WHEN ok AND l AND u THEN upper(v) END AS mixed_hex FROM k"""
)
def hex_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(HEX_SQL.replace("VARCHAR", "STRING")).alias("v"))
    cased = {"lower": F.lower, "upper": F.upper, "mixed": F.upper}
    return rows.select("o_orderkey", *[f(F.hex(codecs.hex_strict(F.col("v"), c))).alias(f"{c}_hex") for c, f in cased.items()])


@query("SELECT doc_id, base64(encode(text)) AS encoded, CASE WHEN text <> '' THEN md5(text) END AS decoded_md5 FROM documents")
def base64_strict_whole(spark, sf_dir):
    # Spark breaks lines after 76 characters, which strict decoding refuses.
    encoded = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", encoded.alias("encoded"))
    return docs.withColumn("decoded_md5", F.md5(codecs.base64_bytes(F.col("encoded"))))


@query()
def utf16_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.transform(F.sequence(F.lit(0), F.char_length("text"), F.lit(97)), lambda x: x.cast("long")).alias("units"))
    return docs.select("doc_id", "units", text.utf16_offsets(F.col("text"), F.col("units")).alias("bytes"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, strlen(text) AS n_bytes FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", canonical.sha256_column(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id // 1000 AS block, count(*) AS rows, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY doc_id // 1000")
def input_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return canonical.block_digests(docs, F.floor(F.col("doc_id") / 1000), F.col("doc_id"), F.sha2("text", 256))


@query(
    """WITH m(label, family) AS (SELECT 'flag-' || f || '-' || i, 'family-' || f || (i % 2) FROM (VALUES ('A'), ('R')) a(f), range(4) b(i)),
        l AS (SELECT 'flag-' || l_returnflag || '-' || (l_partkey % 6) AS label FROM lineitem)
        SELECT l.label, coalesce(m.family, '~unrecognized') AS family, count(*) AS findings FROM l LEFT JOIN m ON m.label = l.label GROUP BY ALL"""
)
def family_map(spark, sf_dir):
    rows = [(f"flag-{f}-{i}", f"family-{f}{i % 2}") for f in "AR" for i in range(4)]
    mapping = spark.createDataFrame(rows, "label string, family string")
    labels = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("flag"), "l_returnflag", F.col("l_partkey") % 6).alias("label"))
    return labels.join(mapping, "label", "left").groupBy("label", F.coalesce("family", F.lit("~unrecognized")).alias("family")).agg(F.count("*").alias("findings"))


@query(
    """WITH f AS (SELECT scanner, case_id, start_byte, end_byte, max(last.f) AS family, emit_seq FROM found GROUP BY ALL),
        k AS (SELECT scanner, CASE WHEN family IS NOT NULL THEN 0 WHEN emit_seq % 4 = 0 THEN 1 WHEN emit_seq % 4 = 1 THEN 2 ELSE 3 END AS r FROM f),
        z AS (SELECT s.scanner, r FROM (SELECT DISTINCT scanner FROM k) s, range(4) t(r))
        SELECT z.scanner, CASE z.r WHEN 0 THEN 'mapped' WHEN 1 THEN 'credential' WHEN 2 THEN 'not-credential' ELSE 'ambiguous' END AS disposition, count(k.r) AS findings
        FROM z LEFT JOIN k ON k.scanner = z.scanner AND k.r = z.r GROUP BY ALL""",
    scored=True,
)
def scope_accounting(spark, sf_dir):
    scope = spark.createDataFrame([("label-0", "credential"), ("label-1", "not-credential"), ("label-2", "ambiguous")], "label string, disposition string")
    found = measure.dedupe_findings(corpus(spark, sf_dir).findings)
    label = lambda x: F.concat(F.lit("label-"), x)
    labels = F.when(F.col("emit_seq") % 4 == 0, F.array(label(F.lit(2)), label(F.lit(0)))).otherwise(F.array(label(F.col("emit_seq") % 4)))
    return accounting.scope_accounting(found.withColumn("labels", labels), scope)


@query()
def line_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.line_chunks(F.col("text"), 2000)).alias("chunk", "body"))
    return docs.select("doc_id", "chunk", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("digest"))


@query(
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, [doc_id % 40 + 1, doc_id % 40 + 1 + doc_id % 7, 300 + doc_id % 50] AS b FROM documents)
        SELECT doc_id AS case_id, CASE WHEN doc_id % 7 = 0 THEN 'not rising' WHEN b[3] >= n THEN 'outside the text' ELSE 'inside a code point' END AS reason FROM b
        WHERE doc_id % 7 = 0 OR b[3] >= n OR len(list_filter(b, lambda x: substr(h, 2 * x + 1, 1) IN ('8', '9', 'A', 'B'))) > 0"""
)
def chunk_problems(spark, sf_dir):
    bounds = F.expr("array(doc_id % 40 + 1, doc_id % 40 + 1 + doc_id % 7, 300 + doc_id % 50)")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("content"), bounds.alias("boundaries"))
    return representation.chunk_problems(docs)


@query("SELECT o_orderkey AS case_id, o_orderkey % 7 > 0 AS matches FROM orders")
def decoded_facts(spark, sf_dir):
    hexed = F.md5(F.col("o_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("é="), F.substring(hexed, 1, 10), F.lit("|"), F.substring(hexed, 11, 22)).alias("content"), F.unhex(hexed).alias("raw"))
    parts = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((3, 13), (14, 36))])
    steps = F.array(F.struct(F.lit("hex").alias("codec"), F.lit("lower").alias("case")))
    digest = F.when(F.col("case_id") % 7 > 0, F.sha2("raw", 256)).otherwise("0")
    return orders.select("case_id", representation.decoded_matches(F.col("content"), parts, steps, digest, F.octet_length("raw")).alias("matches"))


@query(
    """SELECT count(*) AS spans, count(DISTINCT o_orderkey) AS cases, count(*) FILTER (o_orderkey % 3 = 0) AS decoded, count(*) FILTER (o_orderkey % 4 > 1) AS fragmented,
        count(*) FILTER (o_orderkey % 10 = 0) AS rejected, count(*) FILTER (o_orderkey % 6 = 0) AS projections FROM orders"""
)
def representation_report(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as case_id", "o_orderkey % 3 = 0 as decoded", "o_orderkey % 4 as n_fragments", "if(o_orderkey % 10 = 0, 'unpaired-surrogate-split', 'valid') as validity", "if(o_orderkey % 6 = 0, 'projection', 'authored-base') as derivation"
    )
    return representation.representation_report(facts)


@query(
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS a, c_custkey % 3 AS b FROM customer), r AS (SELECT c_custkey AS k, (c_nationkey + c_custkey % 2) % 25 AS a, c_custkey % 3 AS b FROM customer WHERE c_custkey % 5 > 0)
        SELECT c.k AS scanner, CASE WHEN r.k IS NULL THEN 'run' WHEN c.a = r.a THEN 'reuse' ELSE 'rerun' END AS decision, CASE WHEN c.a <> r.a THEN 'version' ELSE '' END AS changed FROM c LEFT JOIN r ON r.k = c.k"""
)
def reuse_decisions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    current = customer.selectExpr("c_custkey as scanner", "c_nationkey as version", "c_custkey % 3 as mode")
    recorded = customer.where("c_custkey % 5 > 0").selectExpr("c_custkey as scanner", "(c_nationkey + c_custkey % 2) % 25 as version", "c_custkey % 3 as mode")
    return runs.reuse_decisions(current, recorded, ["version", "mode"])


@query(
    """SELECT p_partkey % 100 AS scanner, p_partkey AS component, CASE WHEN p_partkey % 11 = 0 THEN 'missing component' ELSE 'digest differs' END AS reason FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0"""
)
def pin_violations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pins = part.selectExpr("p_partkey % 100 as scanner", "p_partkey as component", "md5(cast(p_partkey as string)) as digest")
    seen = part.where("p_partkey % 11 > 0").selectExpr("p_partkey % 100 as scanner", "p_partkey as component", "if(p_partkey % 13 = 0, 'x', md5(cast(p_partkey as string))) as digest")
    return runs.pin_violations(pins, seen)


# ---------------------------------------------------------------- performance

SAMPLES_SQL = """samples AS (SELECT l_suppkey % 40 AS cell, l_suppkey % 2 AS run, CASE l_partkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'candidate' ELSE 'control' END AS arm, l_orderkey % 10 AS round,
        min(CAST(floor(l_extendedprice) AS BIGINT) + CASE WHEN l_partkey % 3 = 1 THEN (l_suppkey % 40 - 20) * 30 ELSE 0 END + 1000) AS ns FROM lineitem GROUP BY ALL)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = "min(cast(floor(l_extendedprice) as bigint) + case when l_partkey % 3 = 1 then (l_suppkey % 40 - 20) * 30 else 0 end + 1000) as ns"
    keys = ["l_suppkey % 40 as cell", "l_suppkey % 2 as run", "case l_partkey % 3 when 0 then 'baseline' when 1 then 'candidate' else 'control' end as arm", "l_orderkey % 10 as round"]
    return table(spark, sf_dir, "lineitem").groupBy(*[F.expr(k) for k in keys]).agg(F.expr(ns))


SUMMARY_SQL = """summary AS (SELECT cell, run, arm, count(*) AS n, min(ns) AS min_ns, CASE WHEN count(*) % 2 = 1 THEN list_sort(list(ns))[count(*) // 2 + 1]
        ELSE list_sort(list(ns))[count(*) // 2] + (list_sort(list(ns))[count(*) // 2 + 1] - list_sort(list(ns))[count(*) // 2]) // 2 END AS median_ns FROM samples GROUP BY cell, run, arm)"""
DIRECTION_SQL = """wide AS (SELECT cell, run, max(median_ns) FILTER (arm = 'baseline') AS bm, max(min_ns) FILTER (arm = 'baseline') AS bn, max(median_ns) FILTER (arm = 'candidate') AS cm, max(min_ns) FILTER (arm = 'candidate') AS cn,
            max(median_ns) FILTER (arm = 'control') AS km, max(min_ns) FILTER (arm = 'control') AS kn FROM summary GROUP BY cell, run),
        won AS (SELECT b.cell, b.run, count(*) AS rounds, count(*) FILTER (c.ns < b.ns) AS less, count(*) FILTER (c.ns > b.ns) AS more FROM samples b JOIN samples c ON c.cell = b.cell AND c.run = b.run AND c.round = b.round
            AND b.arm = 'baseline' AND c.arm = 'candidate' GROUP BY b.cell, b.run),
        ratios AS (SELECT w.cell, w.run, cm / bm AS median_ratio, cn / bn AS min_ratio, greatest(abs(km / bm - 1), abs(kn / bn - 1), CAST(0.05 AS DOUBLE)) AS noise_band, coalesce(rounds, 0) AS rounds, coalesce(less, 0) AS less, coalesce(more, 0) AS more
            FROM wide w LEFT JOIN won ON won.cell = w.cell AND won.run = w.run),
        directions AS (SELECT cell, run, median_ratio, min_ratio, noise_band, CASE WHEN median_ratio < 1 - noise_band AND min_ratio < 1 - noise_band AND rounds > 0 AND less * 5 >= rounds * 4 THEN 'faster'
            WHEN median_ratio > 1 + noise_band AND min_ratio > 1 + noise_band AND rounds > 0 AND more * 5 >= rounds * 4 THEN 'slower' ELSE 'indistinguishable' END AS direction FROM ratios)"""


@query(f"WITH {SAMPLES_SQL}, {SUMMARY_SQL} SELECT * FROM summary")
def timing_summary(spark, sf_dir):
    return perf.timing_summary(_samples(spark, sf_dir), ["cell", "run", "arm"])


@query(f"WITH {SAMPLES_SQL}, {SUMMARY_SQL}, {DIRECTION_SQL} SELECT * FROM directions")
def latency_directions(spark, sf_dir):
    return perf.latency_directions(_samples(spark, sf_dir), ["cell", "run"])


@query(
    f"""WITH {SAMPLES_SQL}, {SUMMARY_SQL}, {DIRECTION_SQL}, g AS (SELECT cell // 2 AS pair, count(*) AS runs, min(direction) AS a, max(direction) AS b FROM directions GROUP BY cell // 2)
        SELECT pair, runs, CASE WHEN a <> b THEN 'unconfirmed' WHEN a = 'faster' THEN 'confirmed-faster' WHEN a = 'slower' THEN 'confirmed-slower' ELSE 'no-evidence' END AS status FROM g WHERE runs >= 2"""
)
def confirm_directions(spark, sf_dir):
    found = perf.latency_directions(_samples(spark, sf_dir), ["cell", "run"]).withColumn("pair", F.floor(F.col("cell") / 2))
    return perf.confirm(found, ["pair"])


@query(
    """WITH arms AS (SELECT l_suppkey AS cell, CASE l_partkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'candidate' ELSE 'control' END AS arm, l_linenumber = 1 AS startup, CAST(floor(l_extendedprice) AS BIGINT) + CASE WHEN l_linenumber = 1 THEN 0 ELSE 3000000 END AS n FROM lineitem),
        a AS (SELECT cell, arm, greatest(min(n) FILTER (NOT startup) - coalesce(min(n) FILTER (startup), 0), 0) AS net, max(n) FILTER (NOT startup) - min(n) FILTER (NOT startup) AS spread FROM arms GROUP BY cell, arm),
        w AS (SELECT cell, max(net) FILTER (arm = 'baseline') AS b, max(net) FILTER (arm = 'candidate') AS c, max(net) FILTER (arm = 'control') AS k, max(spread) AS s FROM a GROUP BY cell),
        r AS (SELECT cell, c / b AS ratio, greatest(greatest(s, abs(k - b)) / b, CAST(0.001 AS DOUBLE)) AS noise_band FROM w)
        SELECT cell, ratio, noise_band, CASE WHEN ratio < 1 - noise_band THEN 'faster' WHEN ratio > 1 + noise_band THEN 'slower' ELSE 'indistinguishable' END AS direction FROM r"""
)
def instruction_directions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as cell", "case l_partkey % 3 when 0 then 'baseline' when 1 then 'candidate' else 'control' end as arm", "l_linenumber = 1 as startup",
        "cast(floor(l_extendedprice) as bigint) + case when l_linenumber = 1 then 0 else 3000000 end as count",
    )
    return perf.instruction_directions(items, ["cell"])


CELL_FIELDS = ["workload", "units", "shape", "rounds"]


@query(
    """WITH q AS (SELECT o_orderkey AS request_id, o_custkey AS workload, o_orderkey % 3 AS units, o_orderstatus AS shape, o_orderkey % 2 AS rounds FROM orders WHERE o_orderkey % 2 = 0),
        s AS (SELECT o_orderkey AS stored_id, o_custkey AS workload, o_orderkey % 3 AS units, o_orderstatus AS shape, (o_orderkey // 2) % 2 AS rounds FROM orders WHERE o_orderkey % 2 = 1),
        j AS (SELECT q.request_id, s.stored_id, (q.units <> s.units)::INT + (q.shape <> s.shape)::INT + (q.rounds <> s.rounds)::INT AS n,
            concat_ws(',', CASE WHEN q.units <> s.units THEN 'units' END, CASE WHEN q.shape <> s.shape THEN 'shape' END, CASE WHEN q.rounds <> s.rounds THEN 'rounds' END) AS changed FROM q JOIN s ON s.workload = q.workload),
        b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n, stored_id) AS k FROM j)
        SELECT q.request_id, CASE WHEN b.n = 0 THEN 'reuse' WHEN b.n > 0 THEN 'rerun-changed' ELSE 'run-new' END AS decision, b.stored_id, CASE WHEN b.n > 0 THEN b.changed END AS changed
        FROM q LEFT JOIN b ON b.request_id = q.request_id AND b.k = 1"""
)
def reuse_plan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fields = ["o_custkey as workload", "o_orderkey % 3 as units", "o_orderstatus as shape"]
    asked = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as request_id", *fields, "o_orderkey % 2 as rounds")
    kept = orders.where("o_orderkey % 2 = 1").selectExpr("o_orderkey as stored_id", *fields, "cast(floor(o_orderkey / 2) as bigint) % 2 as rounds")
    return perf.reuse_plan(asked, kept, CELL_FIELDS)


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 20 AS workload, [CAST(l_quantity AS BIGINT) % 7, CAST(l_discount * 100 AS BIGINT), CAST(l_tax * 100 AS BIGINT), l_partkey % 11, l_linenumber, l_orderkey % 13, l_partkey % 3, l_suppkey % 5] AS a,
          [l_returnflag, l_linestatus, CAST(year(l_shipdate) AS VARCHAR), CAST(month(l_shipdate) AS VARCHAR), CAST(day(l_shipdate) AS VARCHAR), l_returnflag || l_linestatus] AS b, l_orderkey AS o FROM lineitem),
        q AS (SELECT * FROM c WHERE o % 50 = 0), s AS (SELECT * FROM c WHERE o % 50 <> 0),
        j AS (SELECT q.id AS request_id, s.id AS stored_id, len(list_filter(list_zip(q.a, s.a), lambda x: x[1] <> x[2])) + len(list_filter(list_zip(q.b, s.b), lambda x: x[1] <> x[2])) AS n FROM q JOIN s ON q.workload = s.workload)
       SELECT request_id, min(struct_pack(n := n, stored_id := stored_id)).n AS n, min(struct_pack(n := n, stored_id := stored_id)).stored_id AS stored_id FROM j GROUP BY request_id"""
)
def nearest_cells(spark, sf_dir):
    """Line items as cells of fourteen fields, in nested structs; those of every fiftieth order ask for the nearest of their workload."""
    items = table(spark, sf_dir, "lineitem")
    counts = "named_struct('quantity', cast(l_quantity as bigint) % 7, 'discount', cast(l_discount * 100 as bigint), 'tax', cast(l_tax * 100 as bigint), 'part', l_partkey % 11, 'inner', named_struct('line', l_linenumber, 'order', l_orderkey % 13, 'kind', l_partkey % 3, 'supplier', l_suppkey % 5)) as counts"
    labels = "named_struct('flag', l_returnflag, 'status', l_linestatus, 'year', year(l_shipdate), 'month', month(l_shipdate), 'day', day(l_shipdate), 'both', concat(l_returnflag, l_linestatus)) as labels"
    cells = items.selectExpr("l_orderkey", "l_orderkey * 10 + l_linenumber as id", "l_suppkey % 20 as workload", counts, labels)
    fields = perf.flat_fields(cells.select("counts", "labels").schema)
    found = perf.nearest_cells(cells.where("l_orderkey % 50 = 0").withColumnRenamed("id", "request_id"), cells.where("l_orderkey % 50 <> 0").withColumnRenamed("id", "stored_id"), fields, ["workload"])
    return found.select("request_id", F.col("n").cast("bigint").alias("n"), "stored_id")


@query(
    """WITH d(tab, label, type, family, reviewed) AS (SELECT 't0', 'A' || i, NULL, 'fam-' || i, FALSE FROM range(4) r(i) UNION ALL SELECT 't0', 'A1', 'N', 'fam-1-n', FALSE
          UNION ALL SELECT 't1', 'R' || i, NULL, CASE WHEN i < 3 THEN 'fam-' || i END, TRUE FROM range(5) r(i)),
        f AS (SELECT l_orderkey * 10 + l_linenumber AS id, 't' || (l_suppkey % 3) AS tab, l_returnflag || (l_partkey % 6) AS label, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS t0, CASE WHEN l_linenumber % 2 = 0 THEN 'N' END AS type FROM lineitem)
       SELECT f.id, coalesce(a.family, b.family) AS family, CASE WHEN f.tab = 't1' THEN CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.tab = f.tab AND d.label = f.label AND d.reviewed) THEN f.label ELSE '~unrecognized' END ELSE '' END AS labels
       FROM f LEFT JOIN d a ON a.tab = f.tab AND a.label = f.label AND a.type = f.type LEFT JOIN d b ON b.tab = f.tab AND b.label = f.label AND b.type IS NULL"""
)
def label_families(spark, sf_dir):
    """Labels of three tables: with a fallback by type, with reviewed labels, and one that has no entries."""
    rows = [("t0", f"A{i}", None, f"fam-{i}", i, False) for i in range(4)] + [("t0", "A1", "N", "fam-1-n", 4, False), ("t0", "A1", "N", "later", 5, False)]
    rows += [("t1", f"R{i}", None, f"fam-{i}" if i < 3 else None, i, True) for i in range(5)]
    dimension = spark.createDataFrame(rows, "table string, label string, type string, family string, place int, reviewed boolean")
    found = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "concat('t', l_suppkey % 3) as table", "concat(l_returnflag, l_partkey % 6) as label", "if(l_linenumber % 2 = 0, 'N', null) as type")
    return matching.with_family(found, dimension).select("id", "family", F.array_join("labels", ",").alias("labels"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, 'r' || o_orderkey AS tag, 'sha256:' || sha256('r' || o_orderkey) AS pinned FROM orders),
        m AS (SELECT k, tag, CASE WHEN k % 7 = 0 THEN 'other' ELSE pinned END AS digest, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'other' ELSE tag END AS named, CASE WHEN k % 17 = 0 THEN 0 WHEN k % 19 = 0 THEN 2 ELSE 1 END AS n FROM p),
        e AS (SELECT l_orderkey AS k, count(*) AS n, max(CASE WHEN l_suppkey % 9 = 0 THEN 'bad' ELSE 'sha256:' || sha256('s' || l_orderkey) END) AS listed FROM lineitem WHERE l_linenumber = 1 OR l_partkey % 9 = 0 GROUP BY l_orderkey),
        r AS (SELECT m.tag, CASE WHEN m.n = 0 THEN 'manifest missing' WHEN m.n = 2 THEN 'manifest ambiguous' WHEN m.digest = 'other' THEN 'manifest digest differs' WHEN named IS NULL THEN 'manifest has no tag' WHEN named <> tag THEN 'manifest is for another tag'
            WHEN coalesce(e.n, 0) <> 1 THEN 'snapshot isn''t listed exactly once' WHEN listed = 'bad' THEN 'listed digest is invalid' WHEN m.k % 23 = 0 THEN 'snapshot missing' WHEN m.k % 5 = 0 THEN 'snapshot digest differs' END AS reason FROM m LEFT JOIN e ON e.k = m.k)
       SELECT tag, reason FROM r WHERE reason IS NOT NULL"""
)
def release_gate(spark, sf_dir):
    """Orders as releases, their line items as the files that a manifest lists; some are spoiled in each way."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pins = orders.selectExpr("concat('r', o_orderkey) as tag", "concat('sha256:', sha2(concat('r', o_orderkey), 256)) as pinned")
    made = orders.where("o_orderkey % 17 <> 0").selectExpr("concat('r', o_orderkey) as tag", "if(o_orderkey % 7 = 0, 'other', concat('sha256:', sha2(concat('r', o_orderkey), 256))) as digest", "case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'other' else concat('r', o_orderkey) end as named", "explode(if(o_orderkey % 19 = 0, array(0, 1), array(0))) as copy")
    entries = items.selectExpr("concat('r', l_orderkey) as tag", "if(l_linenumber = 1 or l_partkey % 9 = 0, 'snapshot', 'other') as path", "if(l_suppkey % 9 = 0, 'bad', concat('sha256:', sha2(concat('s', l_orderkey), 256))) as listed")
    snapshots = orders.where("o_orderkey % 23 <> 0").selectExpr("concat('r', o_orderkey) as tag", "concat('sha256:', sha2(concat(if(o_orderkey % 5 = 0, 'x', 's'), o_orderkey), 256)) as snapshot")
    return matching.release_violations(pins, made.drop("copy"), entries, snapshots, "snapshot")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 10 AS m FROM documents WHERE text IS NOT NULL)
       SELECT d.doc_id, CASE d.m WHEN 1 THEN 'decoded length or digest differs' WHEN 2 THEN 'a decoding doesn''t follow from the text' WHEN 3 THEN 'fragments aren''t sorted, apart and disjoint' WHEN 4 THEN 'facts of a span that is no secret'
            WHEN 5 THEN 'a boundary splits a surrogate pair of valid input' WHEN 6 THEN 'no boundary splits a surrogate pair' WHEN 7 THEN 'unknown base' ELSE CASE WHEN p.doc_id IS NULL THEN 'unknown base' ELSE 'derives from itself' END END AS reason
       FROM d LEFT JOIN d p ON p.doc_id = CASE WHEN d.m = 8 THEN d.doc_id + 1 ELSE d.doc_id - 1 END WHERE d.m > 0"""
)
def fact_violations(spark, sf_dir):
    """Documents with facts about a secret or a pair of surrogates put after the text; nine in ten are spoiled, each in one way."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", (F.col("doc_id") % 10).alias("m"))
    secret = F.concat(F.lit("secret of document "), F.col("doc_id").cast("string"))
    code, n = F.base64(F.encode(secret, "UTF-8")), F.octet_length("text").cast("long")
    size, units = F.octet_length(code).cast("long"), F.char_length("text") + F.regexp_count("text", F.lit("[\\x{10000}-\\x{10FFFF}]"))
    content = F.when(F.col("m").isin(5, 6), F.concat("text", F.lit("🔑."))).otherwise(F.concat("text", F.substring(code, 1, 8), F.when(F.col("m") == 3, "").otherwise("\n"), F.substring(code, F.lit(9), size)))
    second = n + F.when(F.col("m") == 3, 8).otherwise(9)
    ranges = lambda *pairs: F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")) for a, b in pairs])
    none = lambda kind: F.lit(None).cast(kind)
    base64 = F.struct(F.lit("base64").alias("codec"), F.lit("standard").alias("alphabet"), F.when(code.endswith("="), "padded").otherwise(F.when(size % 4 == 0, "padded").otherwise("unpadded")).alias("padding"), none("string").alias("case"), none("array<string>").alias("code_points"))
    hexed = F.struct(F.lit("hex").alias("codec"), none("string").alias("alphabet"), none("string").alias("padding"), F.lit("lower").alias("case"), none("array<string>").alias("code_points"))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.when(F.col("m") == 1, "other").otherwise(secret), 256))
    decoded = F.struct(F.array(F.when(F.col("m") == 2, hexed).otherwise(base64)).alias("via"), digest.alias("sha256"), F.octet_length(secret).cast("long").alias("bytes"))
    span = F.struct(n.alias("start"), (second + size - 8).alias("end"), F.when(F.col("m") == 4, "companion").otherwise("secret").alias("role"), ranges((n, n + 8), (second, second + size - 8)).alias("fragments"), decoded.alias("decoded"))
    expected = F.when(F.col("m") < 5, F.array(span)).otherwise(F.array()).cast(f"array<{facts.FACT_SPAN}>")
    partner = F.when(F.col("m") == 7, -1).when(F.col("m") == 8, F.col("doc_id") + 1).otherwise(F.col("doc_id") - 1).cast("string")
    derivation = F.when(F.col("m") >= 7, F.struct(F.lit(facts.PROJECTION).alias("kind"), F.array(partner).alias("bases")))
    chunking = F.when(F.col("m").isin(5, 6), F.struct(F.lit(facts.UTF16).alias("unit"), F.array((units + F.when(F.col("m") == 5, 1).otherwise(2)).cast("long")).alias("boundaries")))
    representation = F.when(F.col("m") >= 5, F.struct(F.when(F.col("m") == 6, facts.SPLIT).otherwise(facts.VALID).alias("input_validity"), derivation.alias("derivation"), chunking.alias("chunking"))).cast(facts.REPRESENTATION)
    cases = docs.select(F.col("doc_id").cast("string").alias("case_id"), content.alias("content"), F.lit("T0").alias("tier"), expected.alias("expected"), representation.alias("representation"))
    return facts.fact_violations(cases).select(F.col("case_id").cast("bigint").alias("doc_id"), "reason")


@query(
    """WITH t AS (SELECT 'scanners' AS name, count(*) AS rows FROM scanners UNION ALL SELECT 'findings', count(*) FROM findings UNION ALL SELECT 'unmeasured', count(*) FROM unmeasured)
       SELECT name, rows, TRUE AS unchanged FROM t""",
    corpus_sql=True,
)
def observation_artifact(spark, sf_dir):
    """An observation set, written as one artifact over an older one and read back."""
    c = corpus(spark, sf_dir)
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    runs.commit_observations(c.scanners.limit(0), c.findings.limit(0), c.unmeasured.limit(0), path, "older")
    runs.commit_observations(c.scanners, c.findings, c.unmeasured, path, "newer")
    changed = artifact.changed_tables(spark, path)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(name not in changed).alias("unchanged")) for name, df in artifact.read_artifact(spark, path).items()]
    return reduce(DataFrame.unionByName, counts)
