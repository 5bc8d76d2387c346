"""Scoring findings as they arrive, against the spans of a fixed corpus: a stream-static join without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.intervals import acceptable_end, acceptable_start, contains, overlaps


def touches(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """(finding columns, span_idx, touch): how each finding of a stream meets each secret that it overlaps.

    EXACT, COVERED, OVERBROAD or PARTIAL as of this finding alone; a span's
    outcome is the best of its touches, and a MISS without any.
    """
    s = spans.where("role = 'secret'").select(F.col("case_id").alias("s_case"), "span_idx", F.col("start_byte").alias("s_start"), F.col("end_byte").alias("s_end"), acceptable_start().alias("a_start"), acceptable_end().alias("a_end"))
    start, end, s_start, s_end = (F.col(c) for c in ("start_byte", "end_byte", "s_start", "s_end"))
    joined = findings.join(s, (F.col("case_id") == F.col("s_case")) & overlaps(start, end, s_start, s_end))
    inside = contains(start, end, s_start, s_end)
    touch = (
        F.when((start == s_start) & (end == s_end), "EXACT")
        .when(inside & contains(F.col("a_start"), F.col("a_end"), start, end), "COVERED")
        .when(inside, "OVERBROAD")
        .otherwise("PARTIAL")
    )
    return joined.select(*findings.columns, "span_idx", touch.alias("touch"))


def best_touch(touched: DataFrame) -> DataFrame:
    """(scanner, case_id, span_idx, outcome) of what has arrived: an update-mode aggregate on a stream, a plain one on a table."""
    ranks = F.create_map(*[x for i, t in enumerate(("EXACT", "COVERED", "OVERBROAD", "PARTIAL")) for x in (F.lit(t), F.lit(i))])
    names = F.array(*[F.lit(t) for t in ("EXACT", "COVERED", "OVERBROAD", "PARTIAL")])
    best = touched.withColumn("r", ranks[F.col("touch")]).groupBy("scanner", "case_id", "span_idx").agg(F.min("r").alias("r"))
    return best.select("scanner", "case_id", "span_idx", F.element_at(names, F.col("r") + 1).alias("outcome"))
