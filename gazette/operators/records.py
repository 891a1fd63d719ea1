"""Output page records and ledger rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.common import blank_to_null
from gazette.functions.dates import iso_date
from gazette.functions.entities import unescape_text
from gazette.functions.payload import analysis_defaults, ledger_analysis, parse_analysis
from gazette.functions.text import cap_chunks, chunk_words, clean_content, clean_quotes
from gazette.functions.urls import is_web_url
from gazette.schemas import Settings


def _rich_text(texts: Column) -> Column:
    return F.transform(
        texts, lambda t: F.struct(F.struct(t.alias("content")).alias("text"))
    )


def _names(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("name")))


def page_record(
    articles: DataFrame, settings: Settings = Settings(), parent: str | None = None
) -> DataFrame:
    """One typed page record per article: ``link`` plus the struct ``record``.

    Articles need link, title, content, analysis (raw scorer text), image_url,
    published_date and source. Image and cover are null unless the picture is a web URL.
    """
    raw = F.coalesce("analysis", F.lit(""))
    picture = F.when(is_web_url(F.col("image_url")), F.col("image_url"))
    # one step per stage of the text, so that none is evaluated more than once
    unescaped = articles.withColumns(
        {"title": unescape_text(F.col("title")), "content": unescape_text(F.col("content"))}
    )
    prepared = unescaped.select(
        "link",
        "title",
        cap_chunks(
            chunk_words(F.col("content"), settings.chunk_size), settings.chunk_cap
        ).alias("chunks"),
        analysis_defaults(parse_analysis(raw), raw).alias("a"),
        picture.alias("picture"),
        iso_date(F.col("published_date")).alias("date"),
        F.col("source"),
    )
    link, source = F.col("link"), F.col("source")
    external = F.struct(F.col("picture").alias("url"))
    files = F.array(
        F.struct(
            F.lit("image").alias("name"), F.lit("external").alias("type"), external.alias("external")
        )
    )
    sources = F.when(source != "", F.array(source)).otherwise(F.array().cast("array<string>"))
    has_picture = F.col("picture").isNotNull()

    def typed(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias(kind))

    properties = F.struct(
        F.struct(_rich_text(F.array("title")).alias("title")).alias("Title"),
        typed("url", F.when(is_web_url(link), link)).alias("URL"),
        typed("multi_select", _names(sources)).alias("Flux"),
        typed("date", F.when(F.col("date").isNotNull(), F.struct(F.col("date").alias("start")))).alias("Date"),
        typed("rich_text", _rich_text(F.col("chunks"))).alias("Contenu"),
        typed("checkbox", F.col("a.isCommercial")).alias("Commercial"),
        typed("number", F.col("a.significanceScore")).alias("Score"),
        typed("rich_text", _rich_text(F.array("a.summary"))).alias("Résumé"),
        typed("multi_select", _names(F.col("a.tags"))).alias("Tags"),
        F.struct(F.col("a.isDouble").alias("checkbox")).alias("Double"),
        F.when(has_picture, F.struct(files.alias("files"))).alias("Image"),
    )
    cover = F.when(
        has_picture, F.struct(F.lit("external").alias("type"), external.alias("external"))
    )
    return prepared.select(
        "link",
        F.struct(
            F.struct(F.lit(parent).cast("string").alias("database_id")).alias("parent"),
            properties.alias("properties"),
            cover.alias("cover"),
        ).alias("record"),
    )


def write_page_records(records: DataFrame, path: str) -> None:
    """Page records as JSON lines; absent parts are left out."""
    records.select("record.*").write.mode("append").json(path)


def ledger_rows(
    delivered: DataFrame, run_ts: datetime.datetime, first_ord: Column | None = None
) -> DataFrame:
    """Ledger rows of the articles whose delivery returned status 200.

    Empty strings become null. ``ingest_ord`` continues after ``first_ord``; it is unique
    and grows with partition and row, without a global sort.
    """
    ok = delivered.where(F.col("status") == 200)
    start = F.lit(0) if first_ord is None else first_ord
    return ok.select(
        F.col("link").alias("url"),
        blank_to_null(clean_quotes(F.col("title"))).alias("title"),
        blank_to_null(clean_quotes(clean_content(F.col("content")))).alias("content"),
        ledger_analysis(parse_analysis(F.col("analysis"))).alias("analysis"),
        "published_date",
        blank_to_null(F.col("image_url")).alias("image_url"),
        blank_to_null(F.col("source")).alias("source"),
        F.lit(run_ts).cast("timestamp_ntz").alias("processed_at"),
        blank_to_null(F.col("page_id")).alias("page_id"),
        (start + F.monotonically_increasing_id()).alias("ingest_ord"),
    )


def sparse_json(ledger: DataFrame) -> Column:
    """A ledger row as JSON without its null parts."""
    shown = [
        "url",
        "title",
        "content",
        "analysis",
        iso_date(F.col("published_date")).alias("date"),
        "image_url",
        "source",
        iso_date(F.col("processed_at")).alias("processed_date"),
        F.col("page_id").alias("notion_id"),
    ]
    return F.to_json(F.struct(*shown))


def flat_ledger(ledger: DataFrame) -> DataFrame:
    """The ledger with the duplicate verdict next to the analysis."""
    return ledger.select(
        "url",
        "title",
        "content",
        F.col("processed_at").alias("date"),
        "analysis",
        F.coalesce("analysis.isDouble", F.lit(False)).alias("isDouble"),
        "analysis.similarArticle",
        "analysis.similarityReason",
    )
