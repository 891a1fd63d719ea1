"""Article content and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.common import blank_to_null, skew_join
from gazette.functions.html import article_text, main_image, scan_page
from gazette.functions.text import clean_title
from gazette.functions.urls import (
    ENCLOSURE_SITE,
    needs_scraping,
    snippet_image,
    valid_feed_image,
)


def article_content(pages: DataFrame) -> DataFrame:
    """Cleaned text and main picture of each page (url, html); nulls where not fetched."""
    scanned = pages.select("url", scan_page("html").alias("scan"))
    scan = F.col("scan")
    return scanned.select(
        "url",
        article_text(scan).alias("content"),
        main_image(scan, F.col("url")).alias("image_url"),
    )


def attach_content(entries: DataFrame, content: DataFrame) -> DataFrame:
    """Entries with the fetched text (the feed summary when there is none) and page picture.

    Several pages of one URL count as one, so that no entry is multiplied: a page with text
    comes before one without, then the larger text.
    """
    page = F.struct(blank_to_null(F.col("content")).alias("content"), "image_url")
    one = content.groupBy(F.col("url").alias("link")).agg(F.max(page).alias("page"))
    fetched = one.select(
        "link", F.col("page.content").alias("page_content"), F.col("page.image_url").alias("page_image")
    )
    joined = entries.join(fetched, "link", "left")
    return joined.withColumn(
        "content", F.coalesce(blank_to_null(F.col("page_content")), F.col("summary"))
    ).drop("page_content")


def entry_image(entries: DataFrame, cache: DataFrame, scraped: DataFrame) -> DataFrame:
    """Picture of each entry: summary, content, media content, media thumbnail, then the
    cache, then the scraped picture of a domain that needs scraping.

    ``cache`` and ``scraped`` hold (link, image_url); of several rows of a link one counts, the last in the
    order of its pictures. The cleaned title comes along, as both belong to the same step on an entry.
    """

    def one(pictures, name):
        return pictures.groupBy("link").agg(F.max("image_url").alias(name))

    def checked(url):
        return F.when(valid_feed_image(url), url)

    from_feed = F.coalesce(
        snippet_image(F.col("summary")),
        snippet_image(F.col("content")),
        checked(F.get("media_content", F.lit(0))),
        checked(F.get("media_thumbnail", F.lit(0))),
    )
    joined = (
        entries.withColumn("title", clean_title(F.col("title")))
        .withColumn("feed_image", from_feed)
        .join(one(cache, "cached_image"), "link", "left")
        .join(one(scraped, "scraped_image"), "link", "left")
    )
    usable = needs_scraping(F.col("link")) & valid_feed_image(F.col("scraped_image"))
    return joined.withColumn(
        "image_url",
        F.coalesce("feed_image", "cached_image", F.when(usable, F.col("scraped_image"))),
    ).drop("feed_image", "cached_image", "scraped_image")


def rewrite_image(
    articles: DataFrame,
    rewrites: DataFrame,
    sources: tuple[str, ...] = ("JVC",),
    spread: str = "link",
) -> DataFrame:
    """Replace pictures of some sources by their re-hosted URL (image_url, new_url).

    An unknown picture stays, an empty one is null. Rows that take no part get a key of
    their own, so that they do not all meet under one null key, and one picture used by
    very many articles is salted by column ``spread``.
    """
    takes_part = F.col("source").isin(*sources) & F.col("image_url").isNotNull()
    apart = F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))
    keyed = articles.withColumn("_key", F.when(takes_part, F.col("image_url")).otherwise(apart))
    lookup = rewrites.select(F.col("image_url").alias("_key"), "new_url")
    joined = skew_join(keyed, lookup, "_key", spread=spread, how="left")
    return joined.withColumn(
        "image_url", F.coalesce("new_url", blank_to_null(F.col("image_url")))
    ).select(*articles.columns)


def override_image(
    articles: DataFrame, entries: DataFrame, site: str = ENCLOSURE_SITE, spread: str | None = None
) -> DataFrame:
    """On one site the enclosure picture of the first matching entry replaces the page's.

    The entry side is reduced to one row per link before the join; articles that share a
    URL are salted by column ``spread``, by default by all they hold.
    """
    flagged = entries.where("is_site_enclosure").where(F.col("link").contains(site))
    first = flagged.groupBy(F.col("link").alias("url")).agg(
        F.min_by("image_url", "pos").alias("enclosure_image")
    )
    joined = skew_join(articles, first, "url", spread=spread or articles.columns, how="left")
    return joined.withColumn("image_url", F.coalesce("enclosure_image", "image_url")).select(
        *articles.columns
    )
