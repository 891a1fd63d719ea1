"""The remote page listing and cached pictures."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.schemas import PAGE_BATCH
from gazette.sources.tables import read_if_any

# Fixed value: title of a remote page that has none.
NO_TITLE = "Sans titre"


def parse_page_batch(c: Column) -> Column:
    """A listing response as a struct."""
    return F.from_json(c, PAGE_BATCH)


def page_listing(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """All pages of all responses: id, url (null if absent) and title or its default."""
    pages = batches.select(F.explode(F.col(f"{batch}.results")).alias("page"))
    titles = F.col("page.properties.Title.title")
    return pages.select(
        F.nullif(F.col("page.id"), F.lit("")).alias("page_id"),
        F.col("page.properties.URL.url").alias("url"),
        F.coalesce(F.get(titles, F.lit(0))["text"]["content"], F.lit(NO_TITLE)).alias("title"),
    )


def read_image_cache(spark: SparkSession, path: str, links: DataFrame, besides: str | None = None) -> DataFrame:
    """Newest cached picture (link, image_url) of each of the ``links`` (link); with ``besides`` as if that run had
    not been."""
    kept = read_if_any(spark, path, "link string, image_url string, found_at timestamp_ntz, run string")
    if besides is not None:
        kept = kept.where(F.col("run") != besides)
    asked = kept.join(links.select("link"), "link", "left_semi")
    return asked.groupBy("link").agg(F.max_by("image_url", F.struct("found_at", "run")).alias("image_url"))


def keep_images(pictures: DataFrame, path: str, at: datetime.datetime, run: str) -> None:
    """Add the pictures (link, image_url) that a run found; newer ones come before those of earlier runs, and a
    repeated run overwrites its own."""
    found = pictures.where("link is not null and image_url is not null").groupBy("link").agg(F.max("image_url").alias("image_url"))
    stamped = found.withColumn("found_at", F.lit(at).cast("timestamp_ntz"))
    stamped.write.mode("overwrite").parquet(f"{path}/run={run}")
