"""Which feed entries go on: first k per feed, once per link, not yet in the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_k_per_feed(entries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of every feed in document order, of its newest snapshot.

    Entries without ``fetched_at`` are one snapshot per feed.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so each task sends
    at most ``k`` rows per feed however large one feed is.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if "fetched_at" in entries.columns:
        # one row per feed; a feed's newest time meets its rows before they are ranked
        newest = entries.groupBy(F.col("feed_url").alias("_feed")).agg(F.max("fetched_at").alias("_newest"))
        same = entries["feed_url"].eqNullSafe(newest["_feed"]) & entries["fetched_at"].eqNullSafe(newest["_newest"])
        entries = entries.join(newest, same, "left_semi")
    order = W.partitionBy("feed_url").orderBy("pos")
    return (
        entries.withColumn("feed_rank", F.row_number().over(order)).where(F.col("feed_rank") <= k)
    )


def name_feeds(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach registry order and name; entries of unknown feeds drop out.

    Call after ``first_k_per_feed``, when the entry side is already small. The registry is
    not hinted: the planner broadcasts it when its known size allows.
    """
    return entries.join(registry, "feed_url")


def dedup_batch(entries: DataFrame, order: tuple[str, ...] = ("feed_ord", "pos")) -> DataFrame:
    """One entry per link: the first in feed order, then document order.

    As in ``first_k_per_feed`` the limit runs before the shuffle, so copies of one link
    collapse on the map side.
    """
    ranked = entries.withColumn("_rank", F.row_number().over(W.partitionBy("link").orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def new_articles(entries: DataFrame, ledger: DataFrame, key: str = "link") -> DataFrame:
    """Entries whose link is not in the ledger. Dedup first: then no key is heavy."""
    known = ledger.select(F.col("url").alias(key)).where(F.col(key).isNotNull())
    return entries.join(known, key, "left_anti")


def already_processed(entries: DataFrame, ledger: DataFrame, key: str = "link") -> DataFrame:
    """Entries whose link is in the ledger."""
    known = ledger.select(F.col("url").alias(key)).where(F.col(key).isNotNull())
    return entries.join(known, key, "left_semi")


def feed_counts(entries: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """Per registered feed: entries found, entries after the limit, and whether it is empty."""
    found = entries.groupBy("feed_url").agg(F.count(F.lit(1)).alias("found"))
    counted = registry.join(found, "feed_url", "left").fillna(0, ["found"])
    return counted.select(
        "feed_ord",
        "feed_url",
        "feed_name",
        "found",
        F.least("found", F.lit(k)).alias("after_limit"),
        (F.col("found") == 0).alias("is_empty"),
    )
