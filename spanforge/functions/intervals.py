"""Half-open byte ranges as column expressions, and their union and difference as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (outer_start <= inner_start) & (outer_end >= inner_end)


def acceptable_start() -> Column:
    """Of the envelope where there is one, else of the span."""
    return F.coalesce("env_start", "start_byte")


def acceptable_end() -> Column:
    return F.coalesce("env_end", "end_byte")


#: Ranges are placed by key and slice of so many bytes, so that one key's ranges are as many tasks as it has slices.
SLICE_BYTES = 1 << 16
SLICE = "slice"


def slice_of(byte: Column) -> Column:
    return F.floor(byte / SLICE_BYTES).cast("long")


def placed(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges with the slice that each starts in, placed by key and slice."""
    return ranges.withColumn(SLICE, slice_of(F.col("start_byte"))).repartition(*keys, SLICE)


def merge_ranges(ranges: DataFrame, keys: list[str], counted: bool = False) -> DataFrame:
    """The union of the ranges of each key, as disjoint ranges; touching ones merge. ``counted`` adds n, the ranges merged into each.

    A range starts a new one if it begins after all that began before it have
    ended. That is a running maximum over a key's ranges, made slice by slice: of
    equal starts only the farthest end counts, so that a slice's window has
    ``SLICE_BYTES`` rows at most, and what earlier slices reach is carried over
    from one row a slice. Ranges that are ``placed`` already aren't shuffled again.
    """
    ranges = ranges if SLICE in ranges.columns else placed(ranges, keys)
    cell = [*keys, SLICE]
    starts = ranges.groupBy(*cell, "start_byte").agg(F.max("end_byte").alias("end_byte"), F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*cell).orderBy("start_byte")

    def carry(df: DataFrame, value: Column, name: str) -> DataFrame:
        """Add the maximum of value over earlier slices; a key's first slice needs none."""
        by_slice = df.groupBy(*cell).agg(F.max(value).alias("m")).select(*cell, F.max("m").over(before).alias(name))
        return df.join(by_slice.where(F.col(name).isNotNull() & (F.col(SLICE) > 0)), cell, "left")

    carried = carry(starts, F.col("end_byte"), "far")
    reach = F.greatest("far", F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("start_byte") <= reach, F.lit(None)).otherwise(F.col("start_byte"))
    opened = carry(carried.withColumn("opens", opens), F.col("opens"), "opened")
    island = F.coalesce(F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "opened")
    n = [F.sum("n").alias("n")] if counted else []
    return opened.withColumn("island", island).groupBy(*keys, "island").agg(F.max("end_byte").alias("end_byte"), *n).withColumnRenamed("island", "start_byte")


def slices_of(start: Column, end: Column) -> Column:
    """The slices that a range meets."""
    return F.sequence(slice_of(start), F.greatest(slice_of(start), slice_of(end - 1)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with each right row (r_start, r_end and its other columns but keys) that overlaps them; a left join.

    Both sides are copied to each slice they meet, and a pair meets in the first slice
    that both are in. A left row may come with nulls from its other slices.
    """
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("start_byte").alias("r_start"), F.col("end_byte").alias("r_end"), *[c for c in right.columns if c not in (*keys, "start_byte", "end_byte", SLICE)])
    r = r.withColumn("r_slice", F.explode(slices_of(F.col("r_start"), F.col("r_end"))))
    lefts = left.withColumn("l_slice", F.explode(slices_of(F.col("start_byte"), F.col("end_byte"))))
    same = F.col("l_slice") == F.col("r_slice")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    first = slice_of(F.greatest("start_byte", "r_start")) == F.col("r_slice")
    return lefts.join(r, same & overlaps(F.col("start_byte"), F.col("end_byte"), F.col("r_start"), F.col("r_end")) & first, "left").drop("l_slice", "r_slice", *[f"r_{k}" for k in keys])


def shared_bytes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left's columns, shared): bytes of each left range inside the disjoint right ranges of its key. Left rows that are equal become one."""
    width = F.when(F.col("r_start").isNotNull(), F.least("end_byte", "r_end") - F.greatest("start_byte", "r_start"))
    joined = overlapping(left, right.select(*keys, "start_byte", "end_byte"), keys)
    return joined.groupBy(*left.columns).agg(F.coalesce(F.sum(width), F.lit(0)).alias("shared"))


def bytes_outside(ranges: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outside): bytes of the union of ``ranges`` that the union of ``cover`` doesn't hold."""
    merged = merge_ranges(ranges, keys)
    shared = shared_bytes(merged, merge_ranges(cover, keys), keys)
    return shared.groupBy(*keys).agg(F.sum(F.col("end_byte") - F.col("start_byte") - F.col("shared")).alias("outside"))


def union_array(ranges: Column) -> Column:
    """The union of an array of (s, e) structs within a row, for the few ranges of one text."""
    empty = F.filter(ranges, lambda r: F.lit(False))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
        joins = (F.size(acc) > 0) & (r["s"] <= F.try_element_at(acc, F.lit(-1))["e"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(r["s"].alias("s"), r["e"].alias("e")))))

    return F.aggregate(F.array_sort(ranges), empty, step)
