"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, unused

TEMPERATURE = 0.5
SEED = 20


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, the same in any engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _cdfs(rates: DataFrame) -> DataFrame:
    """(source, cdf): P(X <= k) for k = 0, 1, ... until what is left is below 2**-53; by logarithms, so large rates don't underflow.

    A source has about rate + 10 * sqrt(rate) + 25 of them: running sums over that many rows.
    """
    rate, k = F.col("rate"), F.col("k")
    last = F.when(rate > 0, F.ceil(rate + 10 * F.sqrt(rate) + 25)).otherwise(0).cast("int")
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    factorial = F.sum(F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)).over(upto)
    p = F.when(rate > 0, F.exp(-rate + k * F.ln(rate) - factorial)).otherwise(1.0)
    summed = rows.withColumn("p", p).withColumn("c", F.sum("p").over(upto))
    return summed.groupBy("source").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, *, source_col: str = "source", temperature: float = TEMPERATURE, size: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): the mean number of times each document of a source is repeated.

    rate = weight / sum of weights * size * all documents / documents of the
    source. Without ``weights`` (source, weight) a source weighs n_docs **
    temperature; sources missing from ``weights`` weigh nothing.
    """
    counted = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = counted.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double").alias("weight"))
        weighed = counted.join(given, counted.source.eqNullSafe(given.given), "left").drop("given").fillna(0.0, ["weight"])
    weighed = materialize(weighed, "source-weights")
    total = weighed.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("docs")).first()
    share = F.try_divide("weight", F.lit(total["weight"] or 0.0))
    rate = share * F.lit(size) * F.lit(total["docs"] or 0) / F.col("n_docs")
    return weighed.select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    temperature: float = TEMPERATURE,
    size: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """Repeat each document a Poisson number of times, so that sources reach their weights, and shuffle globally.

    The count inverts the Poisson distribution of the source's rate at a number
    hashed from seed and id: it doesn't depend on partitions, and a lost task
    gives the same rows again. ``copy`` (from 0) and ``shuffle_key`` follow the
    columns of ``docs`` and replace columns of these names. Every row goes to a
    partition by the hash of its own key and is sorted by the key there, which
    puts the rows in an order independent of the input's. A null source is a
    source; rows with equal ids (null: the id "null") get equal counts; an
    empty table gives no rows; texts are not read.
    """
    rates = source_rates(docs, weights, source_col=source_col, temperature=temperature, size=size)
    source, cdf, times = unused([*docs.columns, "copy", "shuffle_key"], "source_", "cdf", "times")
    rates = _cdfs(rates).select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    rates = materialize(rates, "poisson-cdf")  # a row for each source
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    u = uniform(F.lit(f"count:{seed}"), key)
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    counted = (
        docs.select(*[F.col(f"`{c}`") for c in names])
        .join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
        .withColumn(times, F.size(F.filter(cdf, lambda c: c < u)))
        .where(F.col(times) > 0)
    )
    return (
        counted.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("copy"))
        .withColumn("copy", F.col("copy").cast("long"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), key, F.col("copy"))))
        .repartition(F.col("shuffle_key"))
        .sortWithinPartitions("shuffle_key")
    )
