"""Ledger retention, removal and purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gazette.common import micros, skew_join

#: Up to this many rows a top-n plan beats the counting plan.
TOP_N_ROWS = 10_000


def _order_levels(ledger: DataFrame) -> DataFrame:
    """Sort key split into integers of growing precision: day, second, microsecond and block
    of arrival numbers. Compared in turn they give the order date (missing first), arrival."""
    earliest = F.expr("timestamp_ntz'0001-01-01 00:00:00'")
    date = F.coalesce(F.col("published_date"), earliest)
    return ledger.withColumn("_k2", micros(date)).withColumns(
        {
            "_k0": F.expr("_k2 div 86400000000"),
            "_k1": F.expr("_k2 div 1000000"),
            "_k3": F.expr("ingest_ord div 65536"),
        }
    )


def _oldest_by_count(ledger: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest rows without sorting the ledger or gathering it in one task.

    Each step counts rows per key part with map-side combine and fetches one row: the
    part in which row ``n`` falls. Earlier parts go whole, later ones stay, and the next
    step only looks inside. The rows finally ranked share a timestamp and a block of
    arrival numbers.
    """
    inside, left, removed = _order_levels(ledger), n, []
    for key in ("_k0", "_k1", "_k2", "_k3"):
        counts = inside.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        # one row per day, second of it, microsecond of that or block: bounded
        upto = F.sum("_rows").over(W.orderBy(key))
        cut = counts.withColumn("_upto", upto).where(F.col("_upto") >= left).orderBy(key).first()
        if cut is None:
            removed.append(inside)
            return _union(removed, ledger.columns)
        removed.append(inside.where(F.col(key) < cut[key]))
        inside = inside.where(F.col(key) == cut[key])
        left -= cut["_upto"] - cut["_rows"]
    removed.append(inside.orderBy("ingest_ord").limit(left))
    return _union(removed, ledger.columns)


def _union(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def oldest(ledger: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest rows: by date with missing dates first, ties by arrival."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n <= TOP_N_ROWS:
        return ledger.orderBy(F.col("published_date").asc_nulls_first(), "ingest_ord").limit(n)
    return _oldest_by_count(ledger, n)


def retain(ledger: DataFrame, threshold: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the ``n`` oldest rows go once the ledger exceeds ``threshold``.

    ``ingest_ord`` is unique, so it separates the two exactly.
    """
    size = ledger.agg(F.count(F.lit(1))).scalar()
    removed = oldest(ledger, n).where(size > threshold)
    kept = ledger.join(removed.select("ingest_ord"), "ingest_ord", "left_anti")
    return kept.select(*ledger.columns), removed


def archive_set(removed: DataFrame) -> DataFrame:
    """Remote pages to archive: the removed rows that have a page."""
    return (
        removed.where(F.col("page_id").isNotNull() & (F.col("page_id") != ""))
        .select("page_id", "url", "title", F.lit(True).alias("archived"))
    )


def retention_report(ledger: DataFrame, threshold: int, n: int) -> DataFrame:
    """One row: ledger size before, rows removed, size after, pages to archive."""
    _, removed = retain(ledger, threshold, n)
    before = ledger.agg(F.count(F.lit(1)).alias("size_before"))
    gone = removed.agg(
        F.count(F.lit(1)).alias("removed"),
        F.count_if(F.col("page_id").isNotNull() & (F.col("page_id") != "")).alias("to_archive"),
    )
    # two one-row tables
    return before.join(gone, F.lit(True)).select(
        "size_before",
        "removed",
        (F.col("size_before") - F.col("removed")).alias("size_after"),
        "to_archive",
    )


def remove_by_url(ledger: DataFrame, archived: DataFrame) -> DataFrame:
    """Ledger rows whose URL is not among the archived pages; null URLs remove nothing."""
    urls = archived.select("url").where(F.col("url").isNotNull() & (F.col("url") != ""))
    marked = urls.distinct().withColumn("_archived", F.lit(True))
    joined = skew_join(ledger, marked, "url", spread="ingest_ord", how="left")
    return joined.where(F.col("_archived").isNull()).select(*ledger.columns)


def purge_report(outcomes: DataFrame, ledger: DataFrame, logs: DataFrame) -> DataFrame:
    """One row of purge counters.

    ``outcomes`` is the page listing with the archive status per page; ``logs`` holds the
    interaction log, whose days count as files.
    """
    valid = F.col("page_id").isNotNull()
    archived = valid & F.coalesce(F.col("status") == 200, F.lit(False))
    pages = outcomes.agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(archived).alias("archived_pages"),
        F.count_if(archived & F.col("url").isNotNull()).alias("archived_with_url"),
        F.count_if(~valid).alias("pages_without_id"),
        F.count_if(~archived).alias("errors"),
    )
    urls = outcomes.where(archived).select("url").where("url is not null").distinct()
    # counted per URL first, so a URL with very many rows is one row in the join
    held = ledger.groupBy("url").agg(F.count(F.lit(1)).alias("rows"))
    gone = held.join(urls, "url", "left_semi").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("ledger_removed")
    )
    days = logs.agg(F.count_distinct("log_date").alias("logs_removed"))
    # three one-row tables
    return pages.join(gone, F.lit(True)).join(days, F.lit(True))
