"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host; a line that stands on more than ``ratio`` of a host's pages (and on at
least ``min_pages`` of them) is boilerplate of that host and is dropped from the host's pages.

Plan: lines are exploded to a 16-byte key (MD5 of the trimmed line) and counted per (host, key) with
map-side combining, so a line on a third of all pages costs one partial row per task. The texts are
never shuffled by line: a host has at most (mean distinct lines per page / ratio) boilerplate keys,
so they are kept as one array per host and joined to the pages on the host. The key table is stored
first, so the planner broadcasts it only if its measured size is below the threshold; beyond that it
is a sort-merge join, whose hot hosts adaptive execution splits.

Copies: with ``copies_once``, pages of a host that are equal or nearly so are one page, in a line's count and in the
host's total, so the text of a document that stands there in many copies is no boilerplate. Equal pages have the
same MD5. Nearly equal are pages that consist by more than half of lines common on the host and whose smallest such
key is the same; a first count over equal pages finds these lines, the second count decides. Which lines are dropped
from a page does not depend on it. Near copies without common lines (each line changed) share no line to lose.

Defined cases: null host = a host of its own; null text stays null, empty text stays empty; blank
lines are neither counted nor dropped; a line repeated on one page counts once; repeated rows are
pages of their own (but for ``copies_once``); other columns pass through, but for columns named as an output (replaced) and columns
that begin with ``ld_`` (reserved, left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stored

RATIO = 0.1
MIN_PAGES = 5


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, for page tables; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != F.lit(""), F.lower(found))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """16-byte key of a line: MD5 of the line without surrounding blanks."""
    return F.unhex(F.md5(F.trim(line)))


def host_totals(pages: DataFrame, host: Column, page: Column | None = None) -> DataFrame:
    """Pages per host (map-side combined); with ``page``, distinct values of it."""
    found = pages.select(host.alias("ld_host"), *([] if page is None else [page.alias("ld_page")]))
    if page is not None:
        found = found.distinct()
    return found.groupBy("ld_host").agg(F.count(F.lit(1)).alias("ld_pages"))


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO,
                      min_pages: int = MIN_PAGES, page: Column | None = None) -> DataFrame:
    """(ld_host, ld_key, ld_count, ld_pages) of every line above the ratio; rows are counted, with ``page`` distinct
    values of it."""
    page_lines = F.filter(F.array_distinct(F.transform(_lines(text), lambda x: F.trim(x))), lambda x: x != F.lit(""))
    of_page = [] if page is None else [page.alias("ld_page")]
    lines = (
        pages.select(host.alias("ld_host"), *of_page, F.explode(page_lines).alias("ld_line"))
        .select("ld_host", line_key(F.col("ld_line")).alias("ld_key"), *(["ld_page"] if of_page else []))
    )
    if of_page:
        lines = lines.distinct()
    counts = (
        lines.groupBy("ld_host", "ld_key").agg(F.count(F.lit(1)).alias("ld_count"))
        .where(F.col("ld_count") >= F.lit(min_pages))
    )
    totals = stored(host_totals(pages, host, page), "line-dedup-hosts").withColumnRenamed("ld_host", "ld_total_host")
    return (
        counts.join(totals, F.col("ld_host").eqNullSafe(F.col("ld_total_host")))
        .where(F.col("ld_count") > F.lit(float(ratio)) * F.col("ld_pages"))
        .select("ld_host", "ld_key", "ld_count", "ld_pages")
    )


def _keys_per_host(found: DataFrame) -> DataFrame:
    return stored(
        found.groupBy(F.col("ld_host").alias("ld_found_host")).agg(F.collect_list("ld_key").alias("ld_keys")),
        "line-dedup-keys",
    )


def _with_hits(pages: DataFrame, host: Column, text: Column, per_host: DataFrame) -> DataFrame:
    """``pages`` with ``ld_host``, ``ld_found_host``, ``ld_keys`` and ``ld_hits``, the few keys that the page has."""
    # hash-based, linear in the lines and the keys
    hits = F.when(
        F.col("ld_keys").isNotNull(),
        F.array_intersect(F.col("ld_keys"), F.transform(_lines(text), line_key)),
    )
    return pages.withColumn("ld_host", host).join(
        per_host, F.col("ld_host").eqNullSafe(F.col("ld_found_host")), "left").withColumn("ld_hits", hits)


def _has_hits() -> Column:
    return F.size(F.coalesce(F.col("ld_hits"), F.array().cast("array<binary>"))) > 0


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(F.trim(x)))


def _copies_once(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """``boilerplate_lines`` where equal and nearly equal pages of a host are one page."""
    equal = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    first = _keys_per_host(boilerplate_lines(pages, host, text, ratio, min_pages, equal))
    common = F.filter(_lines(text), lambda x: F.array_contains(F.col("ld_hits"), line_key(x)))
    nearly = _has_hits() & (2 * _chars(common) > _chars(_lines(text)))
    counted = _with_hits(pages, host, text, first).withColumn(
        "ld_page", F.when(nearly, F.array_min("ld_hits")).otherwise(equal))
    return boilerplate_lines(counted, F.col("ld_host"), text, ratio, min_pages, F.col("ld_page"))


def line_dedup(pages: DataFrame, host: Column | str = "source", text: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``pages`` with the boilerplate lines dropped from ``text``; adds ``n_lines`` (lines of the
    input text) and ``n_dropped``. With ``copies_once``, copies of a page count as one page."""
    host = F.col(host) if isinstance(host, str) else host
    pages = pages.drop(*[c for c in pages.columns if c.startswith("ld_")])
    count = _copies_once if copies_once else boilerplate_lines
    per_host = _keys_per_host(count(pages, host, F.col(text), ratio, min_pages))
    joined = _with_hits(pages, host, F.col(text), per_host)
    has_hits = _has_hits()
    kept = F.when(has_hits, F.filter(
        F.col("ld_lines"),
        lambda x: (F.trim(x) == F.lit("")) | ~F.array_contains(F.col("ld_hits"), line_key(x)),
    )).otherwise(F.col("ld_lines"))
    return (
        joined.withColumn("ld_lines", _lines(F.col(text)))
        .withColumn("ld_kept", kept)
        .withColumn("n_lines", F.coalesce(F.size("ld_lines"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0))
                    .otherwise(F.size("ld_lines") - F.size("ld_kept")).cast("long"))
        .withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
        .withColumn(text, F.when(has_hits, F.array_join("ld_kept", "\n")).otherwise(F.col(text)))
        .drop("ld_host", "ld_found_host", "ld_keys", "ld_lines", "ld_hits", "ld_kept")
    )
