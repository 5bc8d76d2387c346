"""Detector reports as findings: values are located in their texts, UTF-16 offsets mapped, and failures kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import utf16_offsets
from spanforge.sources.placement import DECODED, DECODED_LINE, KEY_BLOCK, Part, RowRule, place, searches
from spanforge.sources.store import materialize

VALUE_ROW = "rule string, path string, line bigint, value string, tags array<string>"
OFFSET_ROW = "path string, start bigint, end bigint, label string, type string, action string, done boolean, findings bigint"


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of line-delimited JSON; emit_seq follows the byte order of the lines, as reports come in no order of their own."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    good = lines.where("r._corrupt is null")
    return good.select(F.col("value").alias("raw"), "r.*").drop("_corrupt"), lines.where("r._corrupt is not null").select(F.col("value").alias("raw"))


def drop_decoded_duplicates(rows: DataFrame) -> DataFrame:
    """Rows found in decoded text go where a plain row says the same."""
    decoded = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("decoded:"))
    marked = rows.withColumn("decoded", decoded)
    keys = ["rule", "path", "line", "value"]
    plain = marked.where(~F.col("decoded")).select(*[F.col(k).alias(f"p_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"p_{k}"))
        same = one if same is None else same & one
    return marked.where(~F.col("decoded")).unionByName(marked.where("decoded").join(plain, same, "left_anti")).drop("decoded")


#: Tags of rows that were found in decoded text, and the rule of key blocks.
_DECODED, _DEPTH, _KEY_RULE = "decoded:", "decode-depth:", "private-key"


def value_rules() -> list[RowRule]:
    """How a row (rule, value, line, tags) is searched: a decoded key block, a value of a decoded line, or the value as it is."""
    tags, value, line = F.coalesce("tags", F.array().cast("array<string>")), F.col("value"), F.col("line")
    decoded, once = F.array_contains(tags, _DECODED + "base64"), F.array_contains(tags, _DEPTH + "1")
    return [
        RowRule(decoded & (F.col("rule") == _KEY_RULE), once, (Part(value, line, KEY_BLOCK),)),
        RowRule(decoded, once, (Part(value, line, DECODED_LINE),)),
        RowRule(F.lit(True), value != "", (Part(value, line),)),
    ]


def decoded_rule() -> RowRule:
    """A row that names its codecs and depth is searched as the run that decodes to it."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    codecs = F.transform(F.filter(tags, lambda t: t.startswith(_DECODED)), lambda t: F.substring(t, F.lit(len(_DECODED) + 1), F.char_length(t)))
    depths = F.filter(tags, lambda t: t.startswith(_DEPTH))
    depth = F.substring(F.try_element_at(depths, F.lit(-1)), len(_DEPTH) + 1, 10).try_cast("int")
    fits = (F.size(F.array_except(codecs, F.array(F.lit("base64"), F.lit("hex")))) == 0) & depth.isNotNull()
    return RowRule(F.size(codecs) > 0, fits, (Part(F.col("value"), F.col("line"), DECODED, codecs=F.array_sort(F.array_distinct(codecs)), least=depth, most=depth),))


def locate_rows(rows: DataFrame, cases: DataFrame, scanner: str, rules: list[RowRule], first: RowRule | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, unmeasured) of report rows (path, raw, rule) by the rules; rows that ``first`` applies to are tried by it, and by the rules if that fails.

    A report that can't be placed, or a part of it, makes its path unmeasured, and the
    path's findings go. Equal reports claim places in the order of their raw
    text. Findings carry the mapping of a place in decoded text, else null.
    """
    # The rows' order over all paths, without a window on a path.
    rows = materialize(rows.repartitionByRange("path", "raw").sortWithinPartitions("path", "raw").withColumn("emit_seq", F.monotonically_increasing_id()), "rows")
    tried = []
    if first is not None:
        by_first = materialize(place(searches(rows.where(F.coalesce(first.applies, F.lit(False))), [first]), cases), "placed")
        tried.append(by_first.where("reason is null"))
        rows = rows.join(tried[0].select("emit_seq").distinct(), "emit_seq", "left_anti")
    placed = materialize(place(searches(rows, rules), cases), "placed")
    for found in tried:
        placed = placed.unionByName(found)
    failed = placed.where("reason is not null").groupBy("path").agg(F.min("reason").alias("reason"))
    kept = placed.where("reason is null and keeps").join(failed.select("path"), "path", "left_anti")
    found = kept.select(F.lit(scanner).alias("scanner"), "path", "start_byte", "end_byte", F.col("rule").alias("family"), F.lit(None).cast("string").alias("action"), "emit_seq", "mapping")
    return found, failed.select(F.lit(scanner).alias("scanner"), "path", "reason")


def locate_values(rows: DataFrame, cases: DataFrame, scanner: str, *, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, unmeasured) of reports that name a value and perhaps a line; ``decoded``: values of decoded text are first searched as the run they come from."""
    return locate_rows(rows, cases, scanner, value_rules(), decoded_rule() if decoded else None)


def map_offsets(rows: DataFrame, cases: DataFrame, scanner: str) -> tuple[DataFrame, DataFrame]:
    """(findings, problems) of reports with UTF-16 offsets and a closing row that counts them.

    Problems: a count that doesn't match, an unknown path, or an offset inside a surrogate pair or beyond the text.
    """
    said = rows.where("done").agg(F.count("*").alias("closings"), F.sum("findings").alias("said"))
    reported = rows.where("done is null or not done")
    order = Window.partitionBy("path").orderBy("raw")
    joined = reported.withColumn("emit_seq", F.row_number().over(order)).join(cases.select("path", "content"), "path", "left")
    mapped = joined.withColumn("b", utf16_offsets(F.col("content"), F.array("start", "end")))
    start, end = F.col("b")[0], F.col("b")[1]
    good = F.coalesce((start < end), F.lit(False))
    findings = mapped.where(good).select(F.lit(scanner).alias("scanner"), "path", start.alias("start_byte"), end.alias("end_byte"), F.coalesce("type", "label").alias("family"), "action", "emit_seq")
    problems = mapped.where(~good).select("path", F.when(F.col("content").isNull(), "unknown path").otherwise("offset not on a code point").alias("reason"))
    counted = reported.agg(F.count("*").alias("n")).crossJoin(said).where("closings <> 1 or not (said <=> n)")
    return findings, problems.unionByName(counted.select(F.lit(None).cast("string").alias("path"), F.lit("count doesn't match").alias("reason")))
