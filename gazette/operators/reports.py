"""Outcome summaries over delivered articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.sources.tables import read_if_any

#: Logarithm of a sketch's registers: 4,096 of them give a standard error below 2 in 100.
SKETCH_BITS = 12


def source_summary(articles: DataFrame) -> DataFrame:
    """Per source: articles, links, commercial and duplicate share, mean score.

    ``articles`` has source, url and the struct ``analysis``.
    """
    return articles.groupBy("source").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_distinct("url").alias("links"),
        F.count_if("analysis.isCommercial").alias("commercial"),
        F.count_if("analysis.isDouble").alias("doubles"),
        F.round(F.avg(F.col("analysis.isCommercial").cast("int")), 4).alias("commercial_share"),
        F.round(F.avg(F.col("analysis.isDouble").cast("int")), 4).alias("double_share"),
        F.round(F.avg("analysis.significanceScore"), 4).alias("mean_score"),
    )


def tag_rollup(articles: DataFrame) -> DataFrame:
    """Articles and mean score per source and tag, per source, and overall."""
    tagged = articles.select(
        "source",
        F.explode_outer("analysis.tags").alias("tag"),
        F.col("analysis.significanceScore").alias("score"),
    )
    return tagged.rollup("source", "tag").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("articles"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


def link_sketches(articles: DataFrame) -> DataFrame:
    """Per source a sketch of its distinct links (source, url), which can be united with those of other runs."""
    return articles.groupBy("source").agg(F.hll_sketch_agg("url", F.lit(SKETCH_BITS)).alias("links"))


def write_link_sketches(articles: DataFrame, path: str, run: str) -> None:
    """Keep the sketches of a run; a repeated run overwrites its own."""
    link_sketches(articles).write.mode("overwrite").parquet(f"{path}/run={run}")


def read_link_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Sketches (source, links, run) of all runs."""
    return read_if_any(spark, path, "source string, links binary, run string")


def link_counts(sketches: DataFrame) -> DataFrame:
    """Approximate number of distinct links per source over all runs, from their sketches alone."""
    united = F.hll_union_agg("links")
    return sketches.groupBy("source").agg(F.hll_sketch_estimate(united).alias("links"))
