from gazette.schemas import FEED_DOCUMENT
from gazette.sources import feeds

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:media="m" xmlns:dc="d" xmlns:content="c"><channel><title>f</title>
<item><title>Un &amp; deux</title><link>https://h/1</link><description><![CDATA[<p>a</p>]]></description>
<content:encoded><![CDATA[<b>long</b>]]></content:encoded><pubDate>Mon, 01 Jan 2024 10:00:00 +0100</pubDate>
<enclosure type="audio/mpeg" url="a.mp3" length="1"/><enclosure type="image/png" url="a.png"/>
<media:content url="m1" medium="image"/><media:content url="m2"/><media:thumbnail url="t"/></item>
<item><link>https://h/2</link><dc:date>2024-02-03</dc:date></item>
<item><title>x</title><link>https://h/3</link><description>d</description><pubDate>junk</pubDate><dc:date>2024-02-03T01:00:00Z</dc:date></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">T</title>
<link rel="enclosure" type="image/png" href="e.png"/><link rel="alternate" href="https://h/a"/>
<summary>s</summary><published>2024-01-01T00:00:00+02:00</published></entry>
<entry><title>U</title><link href="https://h/b"/><content type="html">c</content><updated>2024-01-02T00:00:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>f</title></channel>
<item><title>R</title><link>https://h/r</link><description>d</description><dc:date>2024-01-01</dc:date></item></rdf:RDF>"""


def entries(spark, bodies):
    rows = [(url, None, body) for url, body in bodies]
    found = feeds.rss_entries(spark.createDataFrame(rows, FEED_DOCUMENT)).collect()
    return {(r["feed_url"], r["pos"]): r for r in found}


def test_rss_fields_in_document_order(spark):
    got = entries(spark, [("f", RSS)])
    first = got["f", 0]
    assert (first["title"], first["link"], first["summary"], first["content"]) == (
        "Un & deux", "https://h/1", "<p>a</p>", "<b>long</b>")
    assert str(first["published_date"]) == "2024-01-01 09:00:00"
    assert first["image_url"] == "a.png" and first["media_content"] == ["m1", "m2"] and first["media_thumbnail"] == ["t"]
    assert not first["is_site_enclosure"]
    second = got["f", 1]
    assert second["title"] is None and second["summary"] is None and str(second["published_date"]) == "2024-02-03 00:00:00"
    assert str(got["f", 2]["published_date"]) == "2024-02-03 01:00:00"


def test_atom_and_rdf(spark):
    got = entries(spark, [("a", ATOM), ("r", RDF)])
    assert (got["a", 0]["title"], got["a", 0]["link"], got["a", 0]["summary"], got["a", 0]["image_url"]) == (
        "T", "https://h/a", "s", "e.png")
    assert str(got["a", 0]["published_date"]) == "2023-12-31 22:00:00"
    assert (got["a", 1]["link"], got["a", 1]["summary"]) == ("https://h/b", "c")
    assert (got["r", 0]["title"], got["r", 0]["link"]) == ("R", "https://h/r")


def test_malformed_and_empty_documents_give_no_rows(spark):
    assert entries(spark, [("x", RSS[:-30]), ("y", "<rss><channel></channel></rss>"), ("z", None), ("w", "")]) == {}


def test_site_enclosure_flag(spark):
    got = entries(spark, [("https://www.jeuxvideo.com/rss/rss.xml", RSS)])
    assert [got[k]["is_site_enclosure"] for k in sorted(got)] == [True, False, False]


def test_incomplete_entries_are_reported(spark):
    found = feeds.rss_entries(spark.createDataFrame([("f", None, RSS)], FEED_DOCUMENT))
    assert [r["link"] for r in feeds.rejected_entries(found).collect()] == ["https://h/2"]
    assert feeds.complete_entries(found).count() == 2


def test_feed_files_take_their_url_from_the_folder(spark, tmp_path):
    folder = tmp_path / "feed_url=https%3A%2F%2Fh%2Ffeed"
    folder.mkdir()
    (folder / "a.xml").write_text(RSS)
    documents = feeds.read_feed_files(spark, str(tmp_path))
    assert {r["feed_url"] for r in feeds.rss_entries(documents).collect()} == {"https://h/feed"}


def test_registry_keeps_order_and_repeated_names(spark):
    rows = feeds.feed_registry(spark).orderBy("feed_ord").collect()
    assert len(rows) == 18 and len({r["feed_url"] for r in rows}) == 18
    assert [r["feed_ord"] for r in rows if r["feed_name"] == "Les Numériques"] == [4, 17]


def test_body_stands_in_for_the_summary_and_a_permanent_guid_for_the_link(spark):
    body = """<rss version="2.0" xmlns:content="c"><channel>
<item><title>a</title><guid>https://h/1</guid><description>d</description></item>
<item><title>b</title><guid isPermaLink="true">https://h/2</guid><content:encoded>body</content:encoded></item>
<item><title>c</title><guid isPermaLink="false">77</guid><description>d</description></item>
<item><title>d</title><link>https://h/4</link><guid>https://h/5</guid><description>d</description><content:encoded>body</content:encoded></item>
</channel></rss>"""
    got = entries(spark, [("f", body)])
    assert [got["f", i]["link"] for i in range(4)] == ["https://h/1", "https://h/2", None, "https://h/4"]
    assert [got["f", i]["summary"] for i in range(4)] == ["d", "body", "d", "d"]
