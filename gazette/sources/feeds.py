"""Feed registry and feed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.dates import first_feed_date
from gazette.functions.urls import ENCLOSURE_SITE, enclosure_image
from gazette.schemas import FEED, FEED_DOCUMENT

# The default registry, in polling order.
DEFAULT_FEEDS = [
    ("https://www.fredzone.org/feed/", "Fredzone"),
    ("https://www.clubic.com/feed/news.rss", "Clubic"),
    ("https://www.01net.com/actualites/feed/", "01Net"),
    ("https://www.generation-nt.com/export/rss.xml", "Generation-NT"),
    ("https://www.lesnumeriques.com/informatique/rss.xml", "Les Numériques"),
    ("https://www.phonandroid.com/feed", "PhonAndroid"),
    ("https://korben.info/feed", "Korben"),
    ("https://www.numerama.com/feed/", "Numerama"),
    ("https://www.frandroid.com/feed", "Frandroid"),
    ("https://www.blogdumoderateur.com/feed/", "BDM"),
    ("https://www.mac4ever.com/flux/rss/content/actu", "Mac4Ever"),
    ("https://consomac.fr/rss/consomac.xml", "Consomac"),
    ("https://fr.motorsport.com/rss/f1/news/", "Motorsport"),
    ("https://f1only.fr/formule1/feed/gn", "F1 Only"),
    ("https://motorsport.nextgen-auto.com/?page=backend&lang=fr", "Nextgen Auto"),
    ("https://www.futura-sciences.com/rss/high-tech/actualites.xml", "Futura Sciences"),
    ("https://www.science-et-vie.com/feed", "Science & Vie"),
    ("https://www.lesnumeriques.com/science-espace/rss.xml", "Les Numériques"),
]

_MEDIA = "array<struct<_url string>>"
_ENCLOSURE = "array<struct<_type string, _url string, _href string>>"
# RSS 2.0 and RSS 1.0 items share their fields; Atom entries link by attribute.
_ITEM = (
    "struct<title string, link string, guid struct<_VALUE string, _isPermaLink string>, description string, `content:encoded` array<string>,"
    " pubDate string, `dc:date` string, updated string, created string, date string,"
    f" enclosure {_ENCLOSURE}, `media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}>"
)
_ENTRY = (
    "struct<title string, link array<struct<_href string, _rel string, _type string>>,"
    " summary string, content array<string>, published string, updated string,"
    f" created string, `media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}>"
)
_DOCUMENT = f"channel struct<item array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>"


def feed_registry(spark: SparkSession, feeds: list[tuple[str, str]] | None = None) -> DataFrame:
    """Registry rows in polling order; the URL is the key."""
    feeds = DEFAULT_FEEDS if feeds is None else feeds
    rows = [(i, url, name) for i, (url, name) in enumerate(feeds)]
    return spark.createDataFrame(rows, FEED)


def read_feed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed documents stored as a Parquet table (feed_url, fetched_at, body)."""
    return spark.read.schema(FEED_DOCUMENT).parquet(path)


def stream_feed_documents(
    spark: SparkSession, path: str, files_per_batch: int = 1000
) -> DataFrame:
    """The same landing table as a stream."""
    return (
        spark.readStream.schema(FEED_DOCUMENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw XML files below ``feed_url=<encoded URL>/`` folders, one document per file."""
    return spark.read.text(path, wholetext=True).select(
        "feed_url",
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )


def _media_urls(c: Column) -> Column:
    return F.transform(c, lambda m: m["_url"])


def _from_item(item: Column) -> Column:
    """An RSS item: the body stands in for a missing summary, a permanent guid for a missing link."""
    permanent = F.lower(F.coalesce(item["guid"]["_isPermaLink"], F.lit("true"))) != "false"
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(item["link"], F.when(permanent, item["guid"]["_VALUE"])).alias("link"),
        F.coalesce(item["description"], F.get(item["content:encoded"], F.lit(0))).alias("summary"),
        F.get(item["content:encoded"], F.lit(0)).alias("content"),
        F.array(
            item["pubDate"], item["updated"], item["created"], item["date"], item["dc:date"]
        ).alias("dates"),
        F.transform(
            item["enclosure"],
            lambda e: F.struct(
                e["_type"].alias("type"), e["_url"].alias("url"), e["_href"].alias("href")
            ),
        ).alias("enclosures"),
        _media_urls(item["media:content"]).alias("media_content"),
        _media_urls(item["media:thumbnail"]).alias("media_thumbnail"),
    )


def _from_entry(entry: Column) -> Column:
    links = entry["link"]
    page = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    attached = F.filter(links, lambda l: l["_rel"] == "enclosure")
    return F.struct(
        entry["title"].alias("title"),
        F.get(page, F.lit(0))["_href"].alias("link"),
        F.coalesce(entry["summary"], F.get(entry["content"], F.lit(0))).alias("summary"),
        F.get(entry["content"], F.lit(0)).alias("content"),
        F.array(
            entry["published"], entry["updated"], entry["created"],
            F.lit(None).cast("string"), F.lit(None).cast("string"),
        ).alias("dates"),
        F.transform(
            attached,
            lambda l: F.struct(
                l["_type"].alias("type"),
                F.lit(None).cast("string").alias("url"),
                l["_href"].alias("href"),
            ),
        ).alias("enclosures"),
        _media_urls(entry["media:content"]).alias("media_content"),
        _media_urls(entry["media:thumbnail"]).alias("media_thumbnail"),
    )


def rss_entries(documents: DataFrame) -> DataFrame:
    """One row per feed entry in document order (``pos``), for RSS and Atom documents.

    A malformed document or one without entries gives no rows here.
    """
    parsed = documents.withColumn(
        "_doc", F.from_xml("body", _DOCUMENT, {"mode": "PERMISSIVE"})
    )
    entries = F.coalesce(
        F.transform(F.col("_doc.channel.item"), _from_item),
        F.transform(F.col("_doc.item"), _from_item),
        F.transform(F.col("_doc.entry"), _from_entry),
    )
    rows = parsed.select("feed_url", "fetched_at", F.posexplode(entries).alias("pos", "e"))
    # the flag only follows feeds of the site whose enclosure wins over the page image
    from_site = F.col("feed_url").contains(ENCLOSURE_SITE)
    image = enclosure_image(F.col("e.enclosures"))
    return rows.select(
        "feed_url",
        "fetched_at",
        "pos",
        "e.title",
        "e.link",
        "e.summary",
        "e.content",
        first_feed_date(F.col("e.dates")).alias("published_date"),
        image.alias("image_url"),
        F.coalesce(from_site & (image != ""), F.lit(False)).alias("is_site_enclosure"),
        "e.enclosures",
        "e.media_content",
        "e.media_thumbnail",
    )


def rejected_entries(entries: DataFrame) -> DataFrame:
    """Entries that cannot be processed: no link, title or summary."""
    return entries.where(
        F.col("link").isNull() | F.col("title").isNull() | F.col("summary").isNull()
    )


def complete_entries(entries: DataFrame) -> DataFrame:
    """Entries with link, title and summary."""
    return entries.dropna(subset=["link", "title", "summary"])
