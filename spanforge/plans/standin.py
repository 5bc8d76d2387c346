"""Corpus tables derived from the given tables: a case for each order, findings from its line items.

Each derivation is written twice, as DataFrames and as common table expressions
for the comparison by SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Corpus:
    cases: DataFrame
    spans: DataFrame
    findings: DataFrame
    scanners: DataFrame
    unmeasured: DataFrame


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cases = orders.selectExpr(
        "o_orderkey as case_id",
        "case when o_orderkey % 4 = 3 then 'must-not-flag' when o_orderkey % 4 = 2 then 'policy' else 'must-redact' end as kind",
        "concat('T', cast(substr(o_orderpriority, 1, 1) as int) % 4) as tier",
        "concat('fam-', o_custkey % 5) as family",
        "case when o_orderkey % 8 = 3 then o_orderkey - 3 when o_orderkey % 8 = 7 then o_orderkey - 1 end as twin_of",
        "concat('suite-', o_custkey % 3) as suite",
    )
    base = orders.where("o_orderkey % 4 <> 3").selectExpr("o_orderkey as case_id", "100 + o_orderkey % 50 as s", "110 + o_orderkey % 50 + o_orderkey % 30 as e", "(o_orderkey % 4) * 2 as m")
    secrets = base.selectExpr("case_id", "0 as span_idx", "'secret' as role", "s as start_byte", "e as end_byte", "case when m > 0 then s - m end as env_start", "case when m > 0 then e + m end as env_end")
    companions = base.where("case_id % 5 = 0").selectExpr("case_id", "1 as span_idx", "'companion' as role", "e + 20 as start_byte", "e + 32 as end_byte", "cast(null as bigint) as env_start", "cast(null as bigint) as env_end")
    second = base.where("case_id % 7 = 0").selectExpr("case_id", "2 as span_idx", "'secret' as role", "e + 5 as start_byte", "e + 15 as end_byte", "cast(null as bigint) as env_start", "cast(null as bigint) as env_end")
    findings = items.selectExpr(
        "concat('scanner-', l_suppkey % 3) as scanner",
        "l_orderkey as case_id",
        "95 + (l_partkey % 12) * 5 as start_byte",
        "100 + (l_partkey % 12) * 5 + ((l_suppkey * 7 + l_linenumber) % 12) * 5 as end_byte",
        "case when l_partkey % 4 > 0 then concat('fam-', l_partkey % 5) end as family",
        "case l_returnflag when 'A' then 'block' when 'R' then 'warn' end as action",
        "cast(floor(l_extendedprice * 100) as bigint) * 10 + l_linenumber as emit_seq",
        "cast(l_linenumber % 2 as int) as replay",
    )
    roster = spark.createDataFrame([(f"scanner-{i}", "complete" if i < 3 else "timeout") for i in range(4)], "scanner string, status string")
    unmeasured = orders.where("o_orderkey % 97 = 0").selectExpr("'scanner-2' as scanner", "o_orderkey as case_id", "'ambiguous-location' as reason")
    return Corpus(cases, secrets.unionByName(companions).unionByName(second), findings, roster, unmeasured)


CORPUS_SQL = """
    cases AS (SELECT o_orderkey AS case_id,
        CASE WHEN o_orderkey % 4 = 3 THEN 'must-not-flag' WHEN o_orderkey % 4 = 2 THEN 'policy' ELSE 'must-redact' END AS kind,
        'T' || (CAST(substr(o_orderpriority, 1, 1) AS INT) % 4) AS tier, 'fam-' || (o_custkey % 5) AS family,
        CASE WHEN o_orderkey % 8 = 3 THEN o_orderkey - 3 WHEN o_orderkey % 8 = 7 THEN o_orderkey - 1 END AS twin_of,
        'suite-' || (o_custkey % 3) AS suite FROM orders),
    base AS (SELECT o_orderkey AS case_id, 100 + o_orderkey % 50 AS s, 110 + o_orderkey % 50 + o_orderkey % 30 AS e, (o_orderkey % 4) * 2 AS m FROM orders WHERE o_orderkey % 4 <> 3),
    spans AS (SELECT case_id, 0 AS span_idx, 'secret' AS role, s AS start_byte, e AS end_byte, CASE WHEN m > 0 THEN s - m END AS env_start, CASE WHEN m > 0 THEN e + m END AS env_end FROM base
        UNION ALL SELECT case_id, 1, 'companion', e + 20, e + 32, NULL, NULL FROM base WHERE case_id % 5 = 0
        UNION ALL SELECT case_id, 2, 'secret', e + 5, e + 15, NULL, NULL FROM base WHERE case_id % 7 = 0),
    findings AS (SELECT 'scanner-' || (l_suppkey % 3) AS scanner, l_orderkey AS case_id, 95 + (l_partkey % 12) * 5 AS start_byte,
        100 + (l_partkey % 12) * 5 + ((l_suppkey * 7 + l_linenumber) % 12) * 5 AS end_byte,
        CASE WHEN l_partkey % 4 > 0 THEN 'fam-' || (l_partkey % 5) END AS family,
        CASE l_returnflag WHEN 'A' THEN 'block' WHEN 'R' THEN 'warn' END AS action,
        CAST(floor(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS emit_seq, l_linenumber % 2 AS replay FROM lineitem),
    scanners AS (SELECT 'scanner-' || i AS scanner, CASE WHEN i < 3 THEN 'complete' ELSE 'timeout' END AS status FROM range(4) t(i)),
    unmeasured AS (SELECT 'scanner-2' AS scanner, o_orderkey AS case_id FROM orders WHERE o_orderkey % 97 = 0)"""

#: Deduplicated findings, outcomes of spans, merged ranges and case results, after CORPUS_SQL.
SCORED_SQL = """
    complete AS (SELECT scanner FROM scanners WHERE status = 'complete'),
    found AS (SELECT scanner, case_id, start_byte, end_byte, arg_max(struct_pack(f := family, a := action), emit_seq) AS last, max(emit_seq) AS emit_seq, count(*) AS reports
        FROM findings GROUP BY scanner, case_id, start_byte, end_byte),
    dd AS (SELECT scanner, case_id, start_byte, end_byte, last.f AS family, last.a AS action, emit_seq, reports FROM found),
    outcomes AS (SELECT c.scanner, s.case_id, s.span_idx, s.start_byte, s.end_byte, s.env_start, s.env_end,
        CASE WHEN bool_or(f.start_byte = s.start_byte AND f.end_byte = s.end_byte) THEN 'EXACT'
             WHEN bool_or(f.start_byte <= s.start_byte AND f.end_byte >= s.end_byte AND f.start_byte >= coalesce(s.env_start, s.start_byte) AND f.end_byte <= coalesce(s.env_end, s.end_byte)) THEN 'COVERED'
             WHEN bool_or(f.start_byte <= s.start_byte AND f.end_byte >= s.end_byte) THEN 'OVERBROAD'
             WHEN count(f.case_id) > 0 THEN 'PARTIAL' ELSE 'MISS' END AS outcome
        FROM spans s CROSS JOIN complete c LEFT JOIN dd f ON f.scanner = c.scanner AND f.case_id = s.case_id AND f.start_byte < s.end_byte AND s.start_byte < f.end_byte
        WHERE s.role = 'secret' GROUP BY c.scanner, s.case_id, s.span_idx, s.start_byte, s.end_byte, s.env_start, s.env_end),
    marks AS (SELECT *, CASE WHEN start_byte <= max(end_byte) OVER (PARTITION BY scanner, case_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM dd),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY scanner, case_id ORDER BY start_byte, end_byte ROWS UNBOUNDED PRECEDING) AS island FROM marks),
    islands AS (SELECT scanner, case_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM numbered GROUP BY scanner, case_id, island),
    leaks AS (SELECT o.scanner, o.case_id, o.span_idx, o.outcome, o.start_byte, o.end_byte, o.env_start, o.env_end,
        coalesce(sum(CASE WHEN i.case_id IS NOT NULL THEN least(o.end_byte, i.end_byte) - greatest(o.start_byte, i.start_byte) END), 0) AS shared
        FROM outcomes o LEFT JOIN islands i ON i.scanner = o.scanner AND i.case_id = o.case_id AND o.start_byte < i.end_byte AND i.start_byte < o.end_byte GROUP BY ALL),
    accepted AS (SELECT case_id, coalesce(env_start, start_byte) AS start_byte, coalesce(env_end, end_byte) AS end_byte FROM spans),
    amarks AS (SELECT *, CASE WHEN start_byte <= max(end_byte) OVER (PARTITION BY case_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM accepted),
    anumbered AS (SELECT *, sum(opens) OVER (PARTITION BY case_id ORDER BY start_byte, end_byte ROWS UNBOUNDED PRECEDING) AS island FROM amarks),
    aislands AS (SELECT case_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM anumbered GROUP BY case_id, island),
    outside1 AS (SELECT i.scanner, i.case_id, i.start_byte, i.end_byte, coalesce(sum(CASE WHEN a.case_id IS NOT NULL THEN least(i.end_byte, a.end_byte) - greatest(i.start_byte, a.start_byte) END), 0) AS shared
        FROM islands i LEFT JOIN aislands a ON a.case_id = i.case_id AND i.start_byte < a.end_byte AND a.start_byte < i.end_byte GROUP BY ALL),
    outside AS (SELECT scanner, case_id, CAST(sum(end_byte - start_byte - shared) AS BIGINT) AS collateral_bytes FROM outside1 GROUP BY scanner, case_id),
    spurious AS (SELECT f.scanner, f.case_id, count(*) AS fp FROM dd f WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.role = 'secret' AND s.case_id = f.case_id AND s.start_byte = f.start_byte AND s.end_byte = f.end_byte) GROUP BY f.scanner, f.case_id),
    positive AS (SELECT l.scanner, l.case_id, string_agg(outcome, ',' ORDER BY span_idx) AS span_outcomes, count(*) AS spans,
        count(*) FILTER (outcome = 'EXACT') AS exact, count(*) FILTER (outcome = 'COVERED') AS covered, count(*) FILTER (outcome = 'OVERBROAD') AS overbroad,
        count(*) FILTER (outcome = 'PARTIAL') AS partial, count(*) FILTER (outcome = 'MISS') AS miss, CAST(sum(end_byte - start_byte) AS BIGINT) AS secret_bytes,
        CAST(sum(CASE WHEN outcome IN ('PARTIAL', 'MISS') THEN end_byte - start_byte - shared ELSE 0 END) AS BIGINT) AS leaked_bytes,
        count(env_start) AS envelope_spans, CAST(coalesce(sum(env_end - env_start - (end_byte - start_byte)), 0) AS BIGINT) AS envelope_bytes
        FROM leaks l GROUP BY l.scanner, l.case_id),
    positives AS (SELECT p.*, coalesce(o.collateral_bytes, 0) AS collateral_bytes, coalesce(x.fp, 0) AS fp FROM positive p
        LEFT JOIN outside o ON o.scanner = p.scanner AND o.case_id = p.case_id LEFT JOIN spurious x ON x.scanner = p.scanner AND x.case_id = p.case_id),
    chits AS (SELECT c.scanner, k.case_id, f.case_id AS hit, f.action, coalesce(k.twin_of IS NOT NULL AND f.family <> k.family, FALSE) AS other
        FROM cases k CROSS JOIN complete c LEFT JOIN dd f ON f.scanner = c.scanner AND f.case_id = k.case_id WHERE k.kind = 'must-not-flag'),
    acts AS (SELECT scanner, case_id, string_agg(action || ':' || n, ',' ORDER BY action) AS action_counts FROM
        (SELECT scanner, case_id, action, count(*) AS n FROM chits WHERE action IS NOT NULL GROUP BY scanner, case_id, action) GROUP BY scanner, case_id),
    control0 AS (SELECT scanner, case_id, count(hit) AS findings, count(*) FILTER (other) AS others FROM chits GROUP BY scanner, case_id),
    controls AS (SELECT c.scanner, c.case_id, c.findings, c.others < c.findings AS flagged, c.others > 0 AS co_detected, a.action_counts
        FROM control0 c LEFT JOIN acts a ON a.scanner = c.scanner AND a.case_id = c.case_id),
    typed AS (SELECT s.scanner, k.*, CASE WHEN s.status <> 'complete' OR u.case_id IS NOT NULL THEN 'not-measured' WHEN k.tier = 'T0' THEN 'pending'
        WHEN k.kind = 'must-not-flag' THEN 'control' ELSE 'positive' END AS measurement_type
        FROM cases k CROSS JOIN scanners s LEFT JOIN unmeasured u ON u.scanner = s.scanner AND u.case_id = k.case_id),
    scored AS (SELECT t.*, p.span_outcomes, p.spans, p.exact, p.covered, p.overbroad, p.partial, p.miss, p.secret_bytes, p.leaked_bytes, p.envelope_spans, p.envelope_bytes, p.collateral_bytes, p.fp,
        c.findings, c.flagged, c.co_detected, c.action_counts FROM typed t
        LEFT JOIN positives p ON t.measurement_type = 'positive' AND p.scanner = t.scanner AND p.case_id = t.case_id
        LEFT JOIN controls c ON t.measurement_type = 'control' AND c.scanner = t.scanner AND c.case_id = t.case_id),
    keyed AS (SELECT *, CASE WHEN tier = 'T0' THEN 'pending/T0' ELSE kind || '/' || tier END AS group_key FROM scored WHERE measurement_type <> 'not-measured'),
    twins AS (SELECT p.scanner, p.group_key, count(*) AS pairs,
        count(*) FILTER (p.partial + p.miss = 0 AND NOT t.flagged) AS discriminated_lenient,
        count(*) FILTER (p.overbroad + p.partial + p.miss = 0 AND NOT t.flagged) AS discriminated_strict,
        count(*) FILTER (t.co_detected) AS co_detected_pairs
        FROM keyed p JOIN keyed t ON t.scanner = p.scanner AND t.twin_of = p.case_id AND t.tier <> 'T0' WHERE p.measurement_type = 'positive' GROUP BY p.scanner, p.group_key),
    counts0 AS (SELECT scanner, group_key, split_part(group_key, '/', 1) AS kind, min(measurement_type) AS population, count(*) AS files,
        CAST(coalesce(sum(spans), 0) AS BIGINT) AS spans, CAST(coalesce(sum(exact), 0) AS BIGINT) AS exact, CAST(coalesce(sum(covered), 0) AS BIGINT) AS covered,
        CAST(coalesce(sum(overbroad), 0) AS BIGINT) AS overbroad, CAST(coalesce(sum(partial), 0) AS BIGINT) AS partial, CAST(coalesce(sum(miss), 0) AS BIGINT) AS miss,
        CAST(coalesce(sum(secret_bytes), 0) AS BIGINT) AS secret_bytes, CAST(coalesce(sum(leaked_bytes), 0) AS BIGINT) AS leaked_bytes,
        CAST(coalesce(sum(collateral_bytes), 0) AS BIGINT) AS collateral_bytes, CAST(coalesce(sum(envelope_spans), 0) AS BIGINT) AS envelope_spans,
        CAST(coalesce(sum(envelope_bytes), 0) AS BIGINT) AS envelope_bytes, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings,
        count(*) FILTER (flagged) AS flagged_files, CAST(coalesce(sum(CASE WHEN measurement_type = 'control' THEN findings ELSE fp END), 0) AS BIGINT) AS fp,
        count(*) FILTER (measurement_type = 'control' AND NOT flagged) AS tn FROM keyed GROUP BY scanner, group_key),
    counts AS (SELECT c.*, coalesce(t.pairs, 0) AS pairs, coalesce(t.discriminated_lenient, 0) AS discriminated_lenient, coalesce(t.discriminated_strict, 0) AS discriminated_strict,
        coalesce(t.co_detected_pairs, 0) AS co_detected_pairs, c.exact AS tp, c.spans - c.exact AS fn, c.partial + c.miss AS leaked_spans
        FROM counts0 c LEFT JOIN twins t ON t.scanner = c.scanner AND t.group_key = c.group_key),
    pend AS (SELECT scanner, kind, count(*) AS pending_files FROM keyed WHERE tier = 'T0' GROUP BY scanner, kind)"""
