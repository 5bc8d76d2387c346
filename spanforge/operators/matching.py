"""Joins that say how many rows they met, label dimensions, and the gate of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING, AMBIGUOUS = "missing", "ambiguous"
#: Fixed value: stands for a label that its table's reviewed labels don't have.
UNRECOGNIZED = "~unrecognized"
DIGEST = "^sha256:[0-9a-f]{64}$"


def match_one(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], reason: str = "reason") -> DataFrame:
    """Left rows with the columns of the one right row of their keys, or nulls and a reason: missing, or ambiguous for several.

    The number is counted inside the plan, before rows meet, so that no left row
    is ever repeated and nothing has to be run to find out. Null keys match nothing.
    """
    met = right.groupBy(*keys).agg(F.count("*").alias("n_"), F.max(F.struct(*columns)).alias("row_"))
    why = F.when(F.col("n_").isNull(), MISSING).when(F.col("n_") > 1, AMBIGUOUS)
    joined = left.join(met, keys, "left").withColumn(reason, why)
    return joined.select(*left.columns, *[F.when(F.col(reason).isNull(), F.col(f"row_.{c}")).alias(c) for c in columns], reason)


def with_family(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add family and labels to rows (table, label, type); columns of these names are replaced.

    ``dimension`` (table, label, type, family, place, reviewed) has all label
    tables. An entry for the row's label and type goes before one for the label
    without type; of equal entries the first in place counts. An unmapped or null label has a null family.
    labels: where a table has reviewed labels, the row's label if it is one of
    them, else ``UNRECOGNIZED``; else, or for a null label, none.
    """
    first = dimension.where("family is not null").groupBy("table", "label", F.coalesce("type", F.lit("")).alias("type")).agg(F.min_by("family", "place").alias("family"))
    families = first.groupBy("table", "label").agg(F.map_from_entries(F.collect_list(F.struct("type", "family"))).alias("families_"))
    marked = dimension.where("reviewed").groupBy("table", "label").agg(F.lit(True).alias("reviewed_"))
    known = families.join(marked, ["table", "label"], "full")
    tables = marked.select("table", F.lit(True).alias("has_reviewed_")).distinct()
    joined = rows.join(known, ["table", "label"], "left").join(tables, "table", "left")
    family = F.coalesce(F.try_element_at("families_", F.when(F.col("type") != "", F.col("type"))), F.try_element_at("families_", F.lit("")))
    recorded = F.when(F.coalesce("reviewed_", F.lit(False)), F.col("label")).otherwise(F.lit(UNRECOGNIZED))
    labels = F.when(F.coalesce("has_reviewed_", F.lit(False)) & F.col("label").isNotNull(), F.array(recorded)).otherwise(F.array().cast("array<string>"))
    return joined.select(*[c for c in rows.columns if c not in ("family", "labels")], family.alias("family"), labels.alias("labels"))


def release_violations(pins: DataFrame, manifests: DataFrame, entries: DataFrame, snapshots: DataFrame, path: str) -> DataFrame:
    """(tag, reason) of pinned releases that don't hold; the first reason counts.

    pins (tag, pinned): the digest that a release's manifest must have. manifests
    (tag, digest, named): the manifest, its digest and the tag it names. entries (tag, path, listed): its
    files. snapshots (tag, snapshot): the digest of the file at ``path`` that was found.
    """
    rows = match_one(pins, manifests, ["tag"], ["digest", "named"], "manifest_reason")
    rows = match_one(rows, entries.where(F.col("path") == path), ["tag"], ["listed"], "entry_reason")
    rows = match_one(rows, snapshots, ["tag"], ["snapshot"], "snapshot_reason")
    reason = (
        F.when(F.col("manifest_reason").isNotNull(), F.concat(F.lit("manifest "), "manifest_reason"))
        .when(~F.col("pinned").eqNullSafe(F.col("digest")), "manifest digest differs")
        .when(F.col("named").isNull(), "manifest has no tag")
        .when(F.col("named") != F.col("tag"), "manifest is for another tag")
        .when(F.col("entry_reason").isNotNull(), "snapshot isn't listed exactly once")
        .when(~F.coalesce(F.col("listed").rlike(DIGEST), F.lit(False)), "listed digest is invalid")
        .when(F.col("snapshot_reason").isNotNull(), F.concat(F.lit("snapshot "), "snapshot_reason"))
        .when(~F.col("snapshot").eqNullSafe(F.col("listed")), "snapshot digest differs")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("tag", "reason")
