"""Line deduplication by a line's frequency within its site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import materialize, unused

MAX_RATIO = 0.05
MIN_PAGES = 3


def _key(line: Column) -> Column:
    """128 bits of a trimmed line; two seeds, as one 64-bit hash would collide at 10**10 lines."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def _pages(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("body")).where(F.col("body").isNotNull())


def boilerplate_lines(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """(host, key, n): the hashes of each host's lines on more than ``max_ratio`` of its pages, and on how many.

    A host has at most (mean distinct lines of a page) / max_ratio of them.
    """
    pages = _pages(docs, text_col, host_col)
    page = [F.xxhash64("body").alias("page_a"), F.xxhash64(F.lit("page"), "body").alias("page_b")] if copies_once else []
    counted = pages.select("host", *page).distinct() if copies_once else pages
    totals = counted.groupBy("host").agg(F.count("*").alias("n_pages"))
    kept = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    lines = pages.select("host", *page, F.explode(F.array_distinct(F.transform(kept, _key))).alias("key"))
    lines = lines.distinct() if copies_once else lines
    common = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return common.join(totals, common.host.eqNullSafe(totals.host)).where(F.col("n") > F.lit(max_ratio) * F.col("n_pages")).select(common.host, "key", "n")


def drop_site_boilerplate(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """Drop the lines that are on more than ``max_ratio`` of their host's pages, ``min_pages`` at least.

    Lines are compared without the spaces around them (a carriage return before
    the line feed isn't one of them: it is part of the line); a line counts once a
    page. Blank lines stay. A page that loses all lines stays with an empty
    text, a null text stays null and isn't counted, pages without a host form
    one host of their own. All columns are returned as they came, but for the
    text; two columns follow, ``lines_in`` and ``lines_dropped`` (they replace
    columns of these names). Repeated rows count as pages of their own, unless
    ``copies_once``: then a host's pages of equal text count as one, so that a
    page with many copies isn't taken for boilerplate.

    A host's boilerplate is one array of hashes; a page's lines meet it by a hash
    set, and then each line is looked up among those that the page itself has.
    """
    found = materialize(boilerplate_lines(docs, text_col=text_col, host_col=host_col, max_ratio=max_ratio, min_pages=min_pages, copies_once=copies_once), "boilerplate")
    # 64 bits do here: a line is compared with its host's few boilerplate lines, not with all lines.
    host, keys, owned, kept = unused([*docs.columns, "lines_in", "lines_dropped"], "host", "keys", "owned", "kept")
    found = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("key.a").alias(keys))
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    own = F.array_intersect(F.col(keys), F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))))
    left = F.when(F.coalesce(F.size(owned), F.lit(0)) == 0, lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(owned), F.xxhash64(F.trim(x))))
    )
    names = [c for c in docs.columns if c not in ("lines_in", "lines_dropped")]
    return (
        docs.select(*[F.col(f"`{c}`") for c in names])
        .join(found, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
        .withColumn(owned, own)
        .withColumn(kept, left)
        .select(
            *[F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines_in"),
            F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias("lines_dropped"),
        )
    )
