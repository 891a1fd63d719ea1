"""Registered queries: every operator over the given tables, whole tables and whole texts.

``documents`` plays the feed entries and the ledger, ``pages`` the scraped pages and the
remote listing, ``labels`` the processed ids and the payload flags, ``events`` the
arriving snapshots, ``conversations`` the interaction log. Where a table lacks a trigger
(pictures, banners, entities, fences) it is concatenated from its columns, the same way
on the SQL side.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gazette.common import micros, new_folder
from gazette.functions import dates, entities, payload, text, urls
from gazette.operators import content as C
from gazette.operators import enrichment as E
from gazette.operators import logs as L
from gazette.operators import records as R
from gazette.operators import reports as P
from gazette.operators import retention as N
from gazette.operators import selection as S
from gazette.operators import similarity as M
from gazette.operators.contents import combined_matches
from gazette.plans import runs
from gazette.schemas import ANALYSIS, FEED_DOCUMENT, Settings
from gazette.sources import feeds, ledger, pages as page_source
from gazette.sources.tables import read_spread, read_table
from gazette.streaming import intake as T

RUN_TS = datetime.datetime(2024, 3, 1, 6, 0, 0)
RUN_DATE = RUN_TS.date()
SETTINGS = Settings(max_articles_per_feed=20, min_content_jaccard=None)


def _table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    read = read_spread if heavy else read_table
    return read(spark, f"{sf}/{name}.parquet")


def _registry(spark: SparkSession, extra: tuple[int, ...] = ()) -> DataFrame:
    numbers = list(range(18)) + list(extra)
    return feeds.feed_registry(spark, [(f"src{i}", f"Feed {i}") for i in numbers])


def _documents(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    return _table(spark, sf, "documents", heavy).selectExpr(
        "doc_id",
        "source",
        "lang",
        "text",
        "substring_index(text, '\n', 1) as title",
        "concat('https://news.example/a/', doc_id) as link",
        "cast(substring(source, 4) as int) as feed_ord",
    )


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).selectExpr(
        "source as feed_url", "doc_id as pos", "link", "title", "text as summary"
    )


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "labels").selectExpr("concat('https://news.example/a/', doc_id) as url")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).selectExpr(
        "link as url",
        "title",
        "text as content",
        f"cast(null as {ANALYSIS.simpleString()}) as analysis",
        "case when doc_id % 11 <> 0 then timestampadd(HOUR, (doc_id * 37) % 1000,"
        " timestamp_ntz'2024-01-01 00:00:00') end as published_date",
        "cast(null as string) as image_url",
        "source",
        "timestamp_ntz'2024-03-01 00:00:00' as processed_at",
        "case when doc_id % 5 <> 0 then concat('p', doc_id) end as page_id",
        "doc_id as ingest_ord",
    )


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, heavy=True).selectExpr("doc_id as id", "title", "text")


# --- selection -------------------------------------------------------------------------


def feed_first_k(spark: SparkSession, sf: str) -> DataFrame:
    kept = S.first_k_per_feed(_entries(spark, sf), 3)
    return S.name_feeds(kept, _registry(spark)).select(
        "feed_ord", "feed_name", "feed_rank", "link", "title"
    )


def feed_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = S.feed_counts(_entries(spark, sf), _registry(spark, (99,)), 20)
    return counted.select("feed_url", "feed_name", "found", "after_limit", "is_empty")


def batch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    entries = _documents(spark, sf).selectExpr(
        "concat('https://news.example/t/', md5(text)) as link", "source as feed_url", "feed_ord", "doc_id as pos"
    )
    return S.dedup_batch(entries)


def new_articles(spark: SparkSession, sf: str) -> DataFrame:
    chosen = runs.select_articles(
        _entries(spark, sf), _registry(spark), _seen(spark, sf), SETTINGS
    )
    return chosen.select(
        "link", "feed_name", text.clean_quotes(text.clean_content(F.col("summary"))).alias("content")
    )


def already_processed(spark: SparkSession, sf: str) -> DataFrame:
    kept = S.first_k_per_feed(_entries(spark, sf), 20)
    return S.already_processed(S.name_feeds(kept, _registry(spark)), _seen(spark, sf)).select(
        "link", "feed_name", "title"
    )


# --- feeds -----------------------------------------------------------------------------

_XMLNS = (
    'xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    ' xmlns:content="http://purl.org/rss/1.0/modules/content/"'
)


def _feed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a feed of two items, and, for every ninth, one more that is cut off."""
    docs = _documents(spark, sf, heavy=True)
    when = F.timestamp_add(
        "MINUTE", F.col("doc_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    )
    mail_date = F.concat(F.lit("Mon, "), F.date_format(when, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    escaped = F.col("title")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    number = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit(f'<?xml version="1.0"?><rss version="2.0" {_XMLNS}><channel><title>f</title><item><title>'),
        escaped, F.lit("</title><link>"), F.col("link"),
        F.lit("</link><description><![CDATA["), F.replace("text", F.lit("]]>"), F.lit("")),
        F.lit("]]></description><pubDate>"), mail_date,
        F.lit('</pubDate><enclosure type="audio/mpeg" url="https://h/a.mp3"/>'
              '<enclosure type="image/jpeg" url="https://h/'), number,
        F.lit('.jpg"/></item><item><title>second</title><link>'), F.col("link"), F.lit("/2</link><description>d"),
        number, F.lit("</description><dc:date>2024-02-03T04:05:06+01:00</dc:date>"
                      '<media:content url="https://h/m.jpg"/><content:encoded>c</content:encoded></item></channel></rss>'),
    )
    cut = F.substr(body, F.lit(1), F.length(body) - 20)
    bodies = F.when(F.col("doc_id") % 9 == 0, F.array(body, cut)).otherwise(F.array(body))
    return docs.select(
        F.col("source").alias("feed_url"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.explode(bodies).alias("body"),
    ).to(FEED_DOCUMENT)


def rss_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = feeds.rss_entries(_feed_documents(spark, sf))
    return entries.select(
        "feed_url", "pos", "title", "link", "summary",
        F.coalesce("content", F.lit("-")).alias("content"),
        dates.iso_date(F.col("published_date")).alias("published"),
        F.coalesce("image_url", F.lit("-")).alias("image_url"),
        F.coalesce(F.get("media_content", F.lit(0)), F.lit("-")).alias("media"),
    )


def entry_date(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events")
    ts = F.col("ts")
    mail = F.date_format(ts, "dd MMM yyyy HH:mm:ss")
    later = F.date_format(F.timestamp_add("HOUR", F.lit(1), ts), "dd MMM yyyy HH:mm:ss")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 6
    published = (
        F.when(kind == 0, F.concat(F.lit("Tue, "), mail, F.lit(" GMT")))
        .when(kind == 1, F.concat(F.lit("Tue, "), later, F.lit(" +0100")))
        .when(kind == 2, F.lit("not a date"))
        .when(kind == 3, F.concat(mail, F.lit(" UT")))
    )
    updated = (
        F.when(kind == 2, F.concat(iso, F.lit("Z")))
        .when(kind == 4, F.concat(iso, F.lit(".250+00:00")))
    )
    parsed = dates.first_feed_date(F.array(published, updated))
    return events.select("event_id", F.coalesce(dates.iso_date(parsed), F.lit("none")).alias("published"))


def enclosure_image(spark: SparkSession, sf: str) -> DataFrame:
    sample = F.expr(
        "array(named_struct('type', 'audio/mpeg', 'url', 'https://h/a.mp3', 'href', cast(null as string)),"
        " named_struct('type', if(doc_id % 4 = 0, 'text/html', 'image/png'),"
        "  'url', if(doc_id % 3 = 0, '', concat('https://h/', doc_id, '.png')),"
        "  'href', concat('https://h/ref/', doc_id)),"
        " named_struct('type', 'image/jpeg', 'url', concat('https://h/last/', source), 'href', ''))"
    )
    return _documents(spark, sf).select("doc_id", urls.enclosure_image(sample).alias("image_url"))


# --- pictures --------------------------------------------------------------------------

_SNIPPET = (
    "concat('<p>', source, '<img class=\"x\" src=\"https://h/', doc_id, '-LOGO.png\">',"
    " if(doc_id % 3 = 0, '', concat('<img alt=\"\" src=''https://h/', doc_id, '.jpg''>')),"
    " '<img src=\"https://h/Icons/', doc_id, '.gif\"></p>')"
)


def snippet_image(spark: SparkSession, sf: str) -> DataFrame:
    html = F.expr(f"concat({_SNIPPET}, text, '<img src=\"https://h/', lang, '/end.jpg\">')")
    return _documents(spark, sf, heavy=True).select("doc_id", urls.snippet_image(html).alias("image_url"))


_IMAGE_TAILS = (
    "element_at(array('/a.jpg', '/LOGO.png', '/Site-Icon.PNG', '/x-min.png', '/pic32x32.gif',"
    " '/v.SVG', '/v.svg.jpg', '/mybrand/a.jpg', '/f.ico', ''), cast(page_id % 10 as int) + 1)"
)
_SITE_IMAGES = (
    "element_at(array('https://www.developpez.com/public/images/logo.png',"
    " 'https://www.developpez.com/images/logos/a.png', 'https://www.developpez.com/i/a.png',"
    " 'https://h/Banner.jpg', 'https://h/banner.jpg', ''), cast(page_id % 6 as int) + 1)"
)


def image_url_valid_feed(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr(f"concat(url, {_IMAGE_TAILS})")
    return _table(spark, sf, "pages").select(
        "page_id", urls.valid_feed_image(url).alias("built_ok"), urls.valid_feed_image(F.col("url")).alias("url_ok")
    )


def image_url_valid_page(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select(
        "page_id",
        urls.valid_page_image(F.expr(_SITE_IMAGES)).alias("site_ok"),
        urls.valid_page_image(F.expr(f"concat(url, {_IMAGE_TAILS})")).alias("built_ok"),
    )


def domain_route(spark: SparkSession, sf: str) -> DataFrame:
    built = F.expr(
        "element_at(array('https://fredzone.org/a', 'https://www.fredzone.org/a', 'http://clubic.com?x=1',"
        " 'https://c.developpez.com/b#c', 'https://developpez.com/', 'https://clubic.com:8080/', url),"
        " cast(page_id % 7 as int) + 1)"
    )
    return _table(spark, sf, "pages").select(
        "page_id", urls.net_location(F.col("url")).alias("host"), urls.needs_scraping(built).alias("scrape")
    )


def image_resolve(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    link = "if(doc_id % 2 = 0, concat('https://clubic.com/', doc_id), link)"
    entries = docs.select(
        F.expr(link).alias("link"),
        F.concat(F.lit("Actualité : "), "title").alias("title"),
        "source",
        F.expr(f"if(doc_id % 4 = 0, {_SNIPPET}, text)").alias("summary"),
        F.expr("if(doc_id % 7 = 0, concat('<img src=\"https://h/c/', doc_id, '.jpg\">'), '')").alias("content"),
        F.expr("if(doc_id % 5 = 0, array(concat('https://h/m/', doc_id, '.jpg')), array())").alias("media_content"),
        F.expr("if(doc_id % 9 = 0, array('https://h/logo.jpg'), null)").alias("media_thumbnail"),
    )
    labels = _table(spark, sf, "labels")
    cache = labels.where("toxic = 1").selectExpr(
        "if(doc_id % 2 = 0, concat('https://clubic.com/', doc_id), concat('https://news.example/a/', doc_id)) as link",
        "concat('https://cache/', doc_id) as image_url",
    )
    scraped = labels.selectExpr(
        "if(doc_id % 2 = 0, concat('https://clubic.com/', doc_id), concat('https://news.example/a/', doc_id)) as link",
        "concat('https://scraped/', doc_id, if(quality = 0, '/logo.png', '/a.png')) as image_url",
    )
    rewrites = cache.selectExpr("image_url", "concat(image_url, '/hosted') as new_url")
    resolved = C.entry_image(entries, cache, scraped)
    return C.rewrite_image(resolved, rewrites, ("src1", "src2", "src3")).select(
        "link", "title", F.coalesce("image_url", F.lit("none")).alias("image_url")
    )


def image_override(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    articles = docs.selectExpr(
        "doc_id",
        "concat('https://', if(doc_id % 3 = 0, 'www.jeuxvideo.com/', 'h/'), md5(title)) as url",
        "concat('https://h/page/', doc_id) as image_url",
    )
    entries = docs.selectExpr(
        "concat('https://', if(doc_id % 2 = 0, 'www.jeuxvideo.com/', 'h/'), md5(title)) as link",
        "doc_id as pos",
        "concat('https://h/enclosure/', doc_id) as image_url",
        "doc_id % 4 <> 1 as is_site_enclosure",
    )
    return C.override_image(articles, entries, spread="doc_id").select("doc_id", "image_url")


# --- page content ----------------------------------------------------------------------


def article_content(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its entry: the fetched text; and, for every tenth, an entry whose fetch failed: its summary."""
    pages = _table(spark, sf, "pages", heavy=True).selectExpr(
        "explode(if(page_id % 10 = 0, array(false, true), array(false))) as failed", "page_id", "url", "html"
    ).selectExpr(
        "page_id", "concat(if(failed, 'https://failed.example/', 'https://news.example/a/'), page_id) as link",
        "concat('summary of ', url) as summary", "if(failed, null, html) as html",
    )
    fetched = C.article_content(pages.select(F.col("link").alias("url"), "html"))
    joined = C.attach_content(pages.select("page_id", "link", "summary"), fetched)
    return joined.select("page_id", "link", "content")


_PICTURED = (
    "case page_id % 6"
    " when 0 then replace(html, '<head>', concat('<head><meta property=\"og:image\" content=\"https://h/og', page_id, '.jpg\">'))"
    " when 1 then replace(html, '<head>', concat('<head><meta name=\"twitter:image\" content=\"https://h/tw', page_id, '.jpg\"/>'))"
    " when 2 then replace(html, '<article>', concat('<img src=\"/early.png\"><article><p><img src=\"https://h/in-logo', page_id, '.jpg\">'))"
    " when 3 then replace(html, '<nav>', concat('<img src=\"/site-logo.png\"><img src=\"/body', page_id, '.jpg\"><nav>'))"
    " when 4 then replace(html, '<nav>', concat('<div class=\"x post-thumbnail\"><a><img src=\"/thumb', page_id, '.jpg\"></a></div><nav>'))"
    " else html end"
)


def main_image(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages", heavy=True).select(
        F.concat(F.lit("https://news.example/a/"), "page_id").alias("url"), F.expr(_PICTURED).alias("html")
    )
    return C.article_content(pages).select("url", F.coalesce("image_url", F.lit("none")).alias("image_url"))


# --- text ------------------------------------------------------------------------------

_BANNERED = (
    "concat('<div class=\"x\">', text, '</div>Ce contenu est bloqué\npar ', source, ' Gérer mes choix<p>', lang,"
    " '</p> Vous gardez la possibilité de\r\nchanger à tout moment \t. En poursuivant votre navigation')"
)


def clean_content(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, heavy=True).select(
        F.concat(F.lit("d"), "doc_id").alias("key"), text.clean_content(F.expr(_BANNERED)).alias("content")
    )
    pages = _table(spark, sf, "pages", heavy=True).select(
        F.concat(F.lit("p"), "page_id").alias("key"), text.clean_content(F.col("html")).alias("content")
    )
    return docs.unionByName(pages)


def clean_quotes(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.expr("concat('« ', lang, ' » \"', text, '“')")
    return _documents(spark, sf).select("doc_id", text.clean_quotes(quoted).alias("content"))


def unescape_text(spark: SparkSession, sf: str) -> DataFrame:
    html = F.expr(
        "concat(html, ' &#8217;&amp;#39;&eacute;t&eacute&#x153;&notit;&unknown;&#128;&#0;\u0001&#', 161 + page_id % 90, '; ')"
    )
    return _table(spark, sf, "pages", heavy=True).select("page_id", entities.unescape_text(html).alias("content"))


def title_clean(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr("concat(if(doc_id % 3 = 0, lang, ''), 'Actualité : ', title, ' Actualité : ', source)")
    return _documents(spark, sf).select("doc_id", text.clean_title(title).alias("title"))


def truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", text.truncate_words(F.col("text"), 200).alias("content"))


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    chunks = text.chunk_words(F.col("text"), 500)
    return _documents(spark, sf, heavy=True).select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))


def chunk_capped(spark: SparkSession, sf: str) -> DataFrame:
    chunks = text.cap_chunks(text.chunk_words(F.col("text"), 1800), 10)
    return _documents(spark, sf, heavy=True).select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))


def topic_id(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", text.topic_id(F.col("title"), F.col("text")).alias("topic_id"))


def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    topics = _documents(spark, sf).select(
        F.col("doc_id").alias("id"), text.topic_id(F.col("title"), F.col("text")).alias("topic_id")
    )
    return M.topic_groups(topics)


# --- payloads --------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "labels").select(
        "doc_id",
        F.expr(
            "case when doc_id % 7 = 0 then concat('plain answer ', doc_id)"
            " when doc_id % 13 = 0 then '[1, 2]'"
            " else concat('```json\n{\"isDouble\": ', if(toxic = 1, 'true', 'false'),"
            " ', \"similarArticle\": null, \"isCommercial\": ', if(quality = 0, 'true', 'false'),"
            " if(doc_id % 5 = 0, '', concat(', \"significanceScore\": ', doc_id % 13)),"
            " ', \"summary\": \"résumé ', doc_id, '\", \"tags\": [\"', if(doc_id % 3 = 0, 'tag', 'Tag'), '\"',"
            " if(doc_id % 4 = 0, ', \"Autre\"', ''), ']}\n```') end"
        ).alias("raw"),
    )


def payload_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _payloads(spark, sf).select("doc_id", payload.parse_analysis(F.col("raw")).alias("p"))
    kept = payload.ledger_analysis(F.col("p"))
    return parsed.select(
        "doc_id",
        "p.parse_ok",
        F.coalesce(F.col("p.isDouble").cast("string"), F.lit("-")).alias("is_double"),
        F.coalesce(F.col("p.summary"), F.lit("-")).alias("summary"),
        F.coalesce(F.array_join("p.tags", "|"), F.lit("-")).alias("tags"),
        kept["summary"].isNull().alias("ledger_empty"),
    )


def payload_defaults(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    filled = _payloads(spark, sf).select(
        "doc_id", payload.analysis_defaults(payload.parse_analysis(raw), raw).alias("a")
    )
    return filled.select(
        "doc_id",
        F.col("a.isDouble").alias("is_double"),
        F.col("a.isCommercial").alias("is_commercial"),
        F.col("a.significanceScore").alias("score"),
        F.col("a.summary").alias("summary"),
        F.array_join("a.tags", "|").alias("tags"),
    )


def payload_validate(spark: SparkSession, sf: str) -> DataFrame:
    parsed = payload.parse_analysis(F.col("raw"))
    return _payloads(spark, sf).select(
        "doc_id", F.array_join(payload.payload_problems(parsed), "|").alias("problems")
    )


# --- records ---------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with an answer text, for labelled documents; others have none."""
    docs = _documents(spark, sf, heavy=True)
    dated = docs.withColumn(
        "published_date",
        F.expr("case when doc_id % 11 <> 0 then timestampadd(HOUR, (doc_id * 37) % 1000,"
               " timestamp_ntz'2024-01-01 00:00:00') end"),
    ).withColumn("image_url", F.expr("if(doc_id % 3 = 0, concat('https://h/', doc_id, '.jpg'), 'relative.jpg')"))
    answers = _payloads(spark, sf).select("doc_id", F.col("raw").alias("analysis"))
    return dated.join(answers, "doc_id", "left").withColumn("content", F.col("text"))


def page_record(spark: SparkSession, sf: str) -> DataFrame:
    p = "record.properties."

    def content(name: str):
        return F.transform(F.col(f"{p}{name}.rich_text"), lambda t: t["text"]["content"])

    return R.page_record(_scored(spark, sf)).select(
        "link",
        F.get(f"{p}Title.title", F.lit(0))["text"]["content"].alias("title"),
        F.col(f"{p}URL.url").alias("url"),
        F.array_join(F.transform(f"{p}Flux.multi_select", lambda t: t["name"]), "|").alias("flux"),
        F.coalesce(f"{p}Date.date.start", F.lit("-")).alias("date"),
        F.size(content("Contenu")).alias("chunks"),
        F.md5(F.array_join(content("Contenu"), "|")).alias("content_md5"),
        F.col(f"{p}Commercial.checkbox").alias("commercial"),
        F.col(f"{p}Score.number").alias("score"),
        F.array_join(content("Résumé"), "|").alias("summary"),
        F.array_join(F.transform(f"{p}Tags.multi_select", lambda t: t["name"]), "|").alias("tags"),
        F.col(f"{p}Double.checkbox").alias("double"),
        F.coalesce(F.get(f"{p}Image.files", F.lit(0))["external"]["url"], F.lit("-")).alias("image"),
        F.coalesce("record.cover.external.url", F.lit("-")).alias("cover"),
    )


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as exported listing responses."""
    page = F.expr(
        "named_struct('id', if(page_id % 17 = 0, null, concat('r', page_id)),"
        " 'properties', named_struct('URL', named_struct('url', if(page_id % 11 = 0, null, url)),"
        "  'Title', named_struct('title', if(page_id % 13 = 0, array(),"
        "   array(named_struct('text', named_struct('content', concat('Page ', page_id))))))))"
    )
    response = F.to_json(
        F.struct(F.array(page).alias("results"), F.lit(False).alias("has_more"))
    )
    raw = _table(spark, sf, "pages").select(response.alias("value"))
    return page_source.page_listing(raw.select(page_source.parse_page_batch(F.col("value")).alias("batch")))


def page_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).select(
        F.coalesce("page_id", F.lit("-")).alias("page_id"), F.coalesce("url", F.lit("-")).alias("url"), "title"
    )


def ledger_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    files = _documents(spark, sf).select(
        F.when(
            F.col("doc_id") % 4 == 0,
            F.to_json(F.array("link", F.concat("link", F.lit("/old")))),
        )
        .when(
            F.col("doc_id") % 4 == 1,
            F.to_json(F.struct(F.array(F.struct(
                F.col("link").alias("url"), "title", F.lit("2024-01-02T03:04:05").alias("date"),
                F.concat(F.lit("n"), "doc_id").alias("notion_id"))).alias("articles"))),
        )
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.array(F.struct(F.col("link").alias("url"), "source"))))
        .otherwise(F.lit('{"articles": [{"url": "x"'))
        .alias("value")
    )
    upgraded = ledger.upgrade_ledger(files)
    dash = F.lit("-")
    return upgraded.select(
        "url",
        F.coalesce("title", dash).alias("title"),
        F.coalesce("source", dash).alias("source"),
        F.coalesce(dates.iso_date(F.col("published_date")), dash).alias("published"),
        F.coalesce("page_id", dash).alias("page_id"),
    )


def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    delivered = _scored(spark, sf).selectExpr(
        "link", "concat('« ', title) as title", f"{_BANNERED} as content", "analysis", "published_date",
        "if(doc_id % 2 = 0, '', image_url) as image_url", "source",
        "if(doc_id % 6 = 0, 400, 200) as status", "if(doc_id % 5 = 0, '', concat('n', doc_id)) as page_id",
    )
    rows = R.ledger_rows(delivered, RUN_TS)
    keys = F.json_object_keys(R.sparse_json(rows))
    dash = F.lit("-")
    return rows.select(
        "url", "title", "content",
        F.coalesce("analysis.summary", dash).alias("summary"),
        F.coalesce(dates.iso_date(F.col("published_date")), dash).alias("date"),
        F.coalesce("image_url", dash).alias("image_url"),
        "source",
        dates.iso_date(F.col("processed_at")).alias("processed_date"),
        F.coalesce("page_id", dash).alias("page_id"),
        F.size(keys).alias("json_keys"),
    )


def interaction_log(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations")
    prompts = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text as prompt")
    answers = turns.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 as turn", "text as response")
    pairs = prompts.join(answers, ["conv_id", "turn"], "left")
    log = L.interaction_log(pairs, RUN_DATE, enabled=True)
    return log.select(
        "conv_id", "turn", F.col("log_date").cast("string").alias("log_date"),
        "prompt_chars", "response_chars", "entry",
    )


# --- retention -------------------------------------------------------------------------


def ledger_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = N.retain(_ledger(spark, sf), 400, 100)
    return kept.select(
        "url", "ingest_ord", F.coalesce(dates.iso_date(F.col("published_date")), F.lit("-")).alias("date")
    )


def archive_set(spark: SparkSession, sf: str) -> DataFrame:
    _, removed = N.retain(_ledger(spark, sf), 100, 100)
    return N.archive_set(removed)


def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    return N.retention_report(_ledger(spark, sf), 400, 100)


def ledger_remove(spark: SparkSession, sf: str) -> DataFrame:
    archived = _table(spark, sf, "labels").selectExpr(
        "if(doc_id % 10 = 0, null, concat('https://news.example/a/', doc_id)) as url"
    )
    return N.remove_by_url(_ledger(spark, sf), archived).select("url", "source")


def purge_report(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = _listing(spark, sf).selectExpr("page_id", "url", "if(page_id like '%7', 500, 200) as status")
    entries = _table(spark, sf, "pages").selectExpr("if(page_id % 2 = 0, url, concat(url, '?x')) as url")
    logs = _table(spark, sf, "events").selectExpr("cast(ts as date) as log_date")
    return N.purge_report(outcomes, entries, logs)


# --- similarity ------------------------------------------------------------------------


def similar_titles(spark: SparkSession, sf: str) -> DataFrame:
    found = M.similar_titles(_articles(spark, sf), 0.7)
    return found.select("id", "match_id", F.round("similarity", 6).alias("similarity"))


def duplicate_flag(spark: SparkSession, sf: str) -> DataFrame:
    articles = _articles(spark, sf).select("id", "title")
    flagged = M.duplicate_flags(articles, M.similar_titles(articles, 0.7))
    return flagged.select(
        "id", "is_double",
        F.coalesce("similar_article", F.lit("-")).alias("similar_article"),
        F.coalesce("similarity_reason", F.lit("-")).alias("similarity_reason"),
    )


def near_dup_content(spark: SparkSession, sf: str) -> DataFrame:
    found = M.near_duplicates(_articles(spark, sf).select("id", "text"))
    return found.select("id", "match_id", F.round("similarity", 6).alias("similarity"))


def duplicate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against a ledger of the labelled ones, by the stored keys of titles and texts."""
    held = _table(spark, sf, "labels").select(F.col("doc_id").alias("ingest_ord"))
    store = ledger.LedgerStore(spark, new_folder(spark, "evidence-ledger"), 0.7, 0.7)
    store.append(_ledger(spark, sf).join(held, "ingest_ord", "left_semi"))
    asked = _articles(spark, sf)
    found = combined_matches(store.earlier_titles(asked.select("id", "title")), store.earlier_contents(asked.select("id", "text")))
    return found.select(
        "id", "match_id",
        *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("title_similarity", "content_similarity", "similarity")],
    )


def embedding_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").selectExpr("vec_id as id", "embedding")
    found = M.similar_vectors(vectors, 0.35)
    return found.select("id", "match_id", F.round("similarity", 6).alias("similarity"))


# --- enrichment ------------------------------------------------------------------------


def commercial_flag(spark: SparkSession, sf: str) -> DataFrame:
    ad = F.expr("concat(title, ' ', text, if(doc_id % 4 = 0, ' Promotion : 20 € jusqu''au 3 mai', ''), if(doc_id % 6 = 0, ' VPN', ''))")
    flagged = _documents(spark, sf, heavy=True).select("doc_id", E.commercial_hits(ad).alias("hits"))
    return flagged.select(
        "doc_id", F.array_join("hits", "|").alias("hits"), E.is_commercial(F.col("hits")).alias("is_commercial")
    )


def significance(spark: SparkSession, sf: str) -> DataFrame:
    articles = _articles(spark, sf).select("id", "title")
    flagged = M.duplicate_flags(articles, M.similar_titles(articles, 0.7))
    return flagged.select("id", E.significance(F.col("similarity")).alias("score"))


def lead_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.lead_summary(_articles(spark, sf).select("id", "text"))


def top_tag(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_tag(_articles(spark, sf).select("id", "text"))


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    history = E.recent_titles(_ledger(spark, sf), SETTINGS.prompt_history).scalar()
    return _documents(spark, sf).select(
        "doc_id", E.build_prompt(F.col("title"), F.col("text"), history).alias("prompt")
    )


def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    history = E.recent_titles(_ledger(spark, sf), SETTINGS.prompt_history)
    # earlier titles and criteria are the same in every prompt
    rest = history.select(E.prompt_size(E.prompt_rest(F.col("history")))).scalar()
    prompts = _documents(spark, sf, heavy=True).select(
        "source", E.prompt_head(F.col("title"), F.col("text")).alias("prompt")
    )
    return E.prompt_budget(prompts, "source", rest)


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels")
    return _documents(spark, sf).join(labels, "doc_id").select(
        "source",
        F.col("link").alias("url"),
        F.struct(
            (F.col("quality") == 0).alias("isDouble"),
            (F.col("toxic") == 1).alias("isCommercial"),
            (F.col("doc_id") % 11).cast("double").alias("significanceScore"),
            F.array(F.initcap("lang")).alias("tags"),
        ).alias("analysis"),
    )


def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.source_summary(_delivered(spark, sf))


def source_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links per source from sketches of eight runs, each document being in two of them: all within 8 in 100 of
    the exact number."""
    path = new_folder(spark, "link-sketches")
    docs = _documents(spark, sf).selectExpr("source", "link as url", "doc_id % 8 as run")
    both = docs.unionByName(docs.withColumn("run", (F.col("run") + 3) % 8))
    sketched = both.groupBy("run", "source").agg(F.hll_sketch_agg("url", F.lit(P.SKETCH_BITS)).alias("links"))
    sketched.write.partitionBy("run").parquet(path)
    counted = P.link_counts(P.read_link_sketches(spark, path)).withColumnRenamed("links", "estimate")
    exact = docs.groupBy("source").agg(F.count_distinct("url").alias("links"))
    near = F.abs(F.col("estimate") - F.col("links")) <= 0.08 * F.col("links")
    return exact.join(counted, "source").select("source", "links", near.alias("near"))


def tag_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = P.tag_rollup(_delivered(spark, sf))
    return rolled.select(
        F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("tag", F.lit("all")).alias("tag"),
        "level", "articles", "mean_score",
    )


def enrich(spark: SparkSession, sf: str) -> DataFrame:
    """The pluggable scorer over every document, with columns computed without joins."""
    ready = _documents(spark, sf, heavy=True).select(
        "link",
        (F.col("doc_id") % 2 == 0).alias("is_double"),
        F.expr("if(doc_id % 2 = 0, title, null)").alias("similar_article"),
        F.expr("if(doc_id % 2 = 0, lang, null)").alias("similarity_reason"),
        E.is_commercial(E.commercial_hits(F.col("text"))).alias("is_commercial"),
        ((F.col("doc_id") % 101) / 10).alias("significance"),
        F.col("title").alias("summary"),
        F.expr("if(doc_id % 3 = 0, null, source)").alias("tag"),
    )
    return _flat_analysis(E.enrich(ready)).select(
        "link", "is_double", "similar_article", "similarity_reason", "is_commercial", "score", "summary", "tags",
        "parse_ok",
    )


def _flat_analysis(df: DataFrame) -> DataFrame:
    dash = F.lit("-")
    return df.withColumns(
        {
            "is_double": F.col("isDouble"),
            "similar_article": F.coalesce("similarArticle", dash),
            "similarity_reason": F.coalesce("similarityReason", dash),
            "is_commercial": F.col("isCommercial"),
            "score": F.col("significanceScore"),
            "tags": F.array_join("tags", "|"),
        }
    )


def article_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: select new articles, clean, match, flag, summarise, tag, score."""
    chosen = runs.select_articles(
        _entries(spark, sf), _registry(spark), _seen(spark, sf), SETTINGS
    )
    articles = chosen.select(
        F.col("pos").alias("id"), "link", "title", F.col("summary").alias("content"),
        F.col("feed_name").alias("source"),
    )
    history = _table(spark, sf, "labels").join(_documents(spark, sf), "doc_id").select(
        (F.col("doc_id") - 1_000_000_000).alias("id"), "title"
    )
    scored = runs.article_pipeline(articles, history, SETTINGS)
    return _flat_analysis(scored).select(
        "link", "source", "text", "is_double", "similar_article", "similarity_reason", "is_commercial",
        "score", "summary", "tags", "parse_ok",
    )


# --- streams ---------------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf: str, copies: int = 1) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # written as a pattern, a table stored as one file streams like a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    repeated = stream.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # arrival times carry no zone; a watermark needs an instant
    instant = F.timestamp_micros(micros(F.col("ts")))
    return repeated.select(
        F.col("event_type").alias("feed_url"),
        F.concat(F.lit("https://news.example/e/"), "event_id").alias("link"),
        instant.alias("fetched_at"),
        F.col("ts").alias("published_date"),
        F.col("event_id").alias("ingest_ord"),
    )


def _instant(c: str):
    """UTC text of an instant whatever the session time zone."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return dates.iso_date(F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch))


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = T.rolled_up(_arrivals(spark, sf, copies=2), T.first_arrivals(), spark, "dedup")
    return out.select("feed_url", "link", _instant("fetched_at").alias("fetched_at"))


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = T.rolled_up(_arrivals(spark, sf), T.feed_window_counts(), spark, "counts")
    return out.select(_instant("window_start").alias("window_start"), "feed_url", "arrivals")


def snapshot_ttl(spark: SparkSession, sf: str) -> DataFrame:
    out = T.rolled_up(_arrivals(spark, sf), T.first_snapshots(), spark, "snapshots")
    return out.select(
        _instant("window_start").alias("window_start"), "feed_url", "link",
        _instant("fetched_at").alias("fetched_at"), "snapshots",
    )


def _stream_ledger(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    """Intake of the events into a ledger that already knows the purchases."""
    store = ledger.LedgerStore(spark, new_folder(spark, "stream-ledger"))
    known = _table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("https://news.example/e/"), "event_id").alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"),
        F.lit(None).cast(ANALYSIS).alias("analysis"), F.col("ts").alias("published_date"),
        F.lit(None).cast("string").alias("image_url"), F.lit("known").alias("source"),
        F.lit(RUN_TS).cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("page_id"), F.col("event_id").alias("ingest_ord"),
    )
    store.append(known)
    query = T.intake_stream(
        _arrivals(spark, sf, copies=2), store, new_folder(spark, "stream-state"), RUN_TS, settings,
        available_now=True,
    )
    query.awaitTermination()
    return store.read()


def stream_intake(spark: SparkSession, sf: str) -> DataFrame:
    kept = _stream_ledger(spark, sf, Settings(auto_clean_threshold=10**12))
    return kept.select("url", "source", dates.iso_date(F.col("published_date")).alias("date"))


def stream_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = _stream_ledger(spark, sf, Settings())
    return kept.select("url", "source", dates.iso_date(F.col("published_date")).alias("date"))


def _land_feeds(spark: SparkSession, sf: str, path: str, first: int, last: int, at: datetime.datetime) -> None:
    """One snapshot of every feed, landed: its documents from ``first`` to ``last`` in order."""
    ranked = _documents(spark, sf).withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id")))
    shown = ranked.where(F.col("rank").between(first, last))
    escaped = F.col("title")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    item = F.concat(
        F.lit("<item><title>"), escaped, F.lit("</title><link>"), "link", F.lit("</link><description><![CDATA["),
        F.replace("text", F.lit("]]>"), F.lit("")), F.lit("]]></description></item>"),
    )
    # a snapshot holds as many entries as a feed shows
    feed = shown.select("source", F.struct("rank", item.alias("xml")).alias("item")).groupBy("source").agg(
        F.array_sort(F.collect_list("item")).alias("items")
    )
    xml = F.array_join(F.transform("items", lambda i: i["xml"]), "")
    feed.select(
        F.col("source").alias("feed_url"),
        F.timestamp_micros(micros(F.lit(at).cast("timestamp_ntz"))).alias("fetched_at"),
        F.concat(F.lit("<rss><channel>"), xml, F.lit("</channel></rss>")).alias("body"),
    ).to(FEED_DOCUMENT).write.mode("append").parquet(path)


def stream_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Two polls of all feeds, the second with entries that the first had, as a stream of whole articles."""
    landing, state = new_folder(spark, "landed-feeds"), new_folder(spark, "article-state")
    store = ledger.LedgerStore(spark, new_folder(spark, "article-ledger"))
    records, steps = new_folder(spark, "page-records"), runs.Steps()
    settings = Settings(max_articles_per_feed=20, auto_clean_threshold=10**12)

    def pages() -> DataFrame:
        return _table(spark, sf, "pages").select(F.concat(F.lit("https://news.example/a/"), "page_id").alias("url"), "html")

    for first, last in ((1, 25), (11, 35)):
        _land_feeds(spark, sf, landing, first, last, RUN_TS + datetime.timedelta(minutes=last))
        stream = T.article_stream(
            feeds.stream_feed_documents(spark, landing), _registry(spark), pages, store, records, state, RUN_TS,
            settings, steps, available_now=True,
        )
        stream.awaitTermination()
    return store.read().select("url", "title", "content", "source", F.col("analysis.isCommercial").alias("is_commercial"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in [
        feed_first_k, feed_counts, batch_dedup, new_articles, already_processed,
        rss_entries, entry_date, enclosure_image, snippet_image, image_url_valid_feed,
        image_url_valid_page, domain_route, image_resolve, image_override,
        article_content, main_image, clean_content, clean_quotes, unescape_text, title_clean,
        truncate_words, chunk_words, chunk_capped, topic_id, topic_groups,
        payload_parse, payload_defaults, payload_validate, page_record, page_listing,
        ledger_upgrade, ledger_append, interaction_log, ledger_retention, archive_set,
        retention_report, ledger_remove, purge_report, similar_titles, duplicate_flag,
        near_dup_content, duplicate_evidence, embedding_neighbors, commercial_flag, significance, lead_summary,
        top_tag, prompt_build, prompt_budget, source_summary, source_links, tag_rollup, enrich,
        article_pipeline, stream_dedup, stream_counts, snapshot_ttl, stream_intake,
        stream_retention, stream_articles,
    ]
}
