import pytest
from pyspark.sql import functions as F

from gazette.operators.content import article_content, attach_content, entry_image, override_image, rewrite_image

PLACES = {
    "article": "<div>x</div><article>un <b>deux</b><script>no</script><!-- no --></article>",
    "class": '<div class="a article-content">un<p>deux</div>',
    "post": '<p>x<div class="post-content">un deux</div>',
    "itemprop": '<div itemprop="articleBody">un deux</div>',
    "entry": '<div class="entry-content">un<br/>deux</div>',
    "order": '<div class="entry-content">no</div><section class="post-content">un deux</section>',
    "nested": "<article>un<article>deux</article></article>x",
    "unclosed": "<article>un<p>deux",
    "entities": "<article>un&nbsp;deux</article>",
}


def contents(spark, pages):
    rows = spark.createDataFrame([(u, h) for u, h in pages], "url string, html string")
    return {r["url"]: (r["content"], r["image_url"]) for r in article_content(rows).collect()}


def test_content_places(spark):
    got = contents(spark, PLACES.items())
    assert {k: v[0] for k, v in got.items()} == {k: "un deux" for k in PLACES}


def test_whole_page_when_the_place_cleans_to_nothing(spark):
    got = contents(
        spark,
        [
            ("empty", "<h1>Titre</h1><article> </article><div class='post-content'>x</div><style>no</style>"),
            ("banner", "<h1>Titre</h1><article>Ce contenu est bloqué a Gérer mes choix</article>fin"),
            ("none", "<title>Titre</title><p>un"),
            ("blank", ""),
            ("failed", None),
        ],
    )
    assert {k: v[0] for k, v in got.items()} == {
        "empty": "Titre x", "banner": "Titrefin", "none": "Titreun", "blank": "", "failed": None,
    }


IMAGES = {
    "og": ('<img src="/1"><meta property="og:image" content="o"><meta name="twitter:image" content="t">', "o"),
    "twitter": ('<meta property="og:image" content=""><meta name="twitter:image" content="t">', "t"),
    "featured": ('<article><img src="a"></article><div class="article-featured-image"><p><img src="f"></div>', "f"),
    "thumb": ('<article><img src="a"></article><div class="post-thumbnail"><img src="f"></div>', "f"),
    "article": ('<figure><img src="g"></figure><article><p><img src="a-logo"></article>', "a-logo"),
    "entry": ('<img class="wp-post-image" src="w"><div class="entry-content"><img src="e"></div>', "e"),
    "own class": ('<figure><img src="g"></figure><img class="x wp-post-image" src="w">', "w"),
    "no src": ('<article><img alt=""><img src="second"></article><figure><img src="g"></figure>', "g"),
    "body": ('<img src="/logo.png"><img><img src="/b.png">', "/b.png"),
    "nothing": ('<img src="/logo.png">', None),
}


@pytest.mark.parametrize("name", IMAGES)
def test_image_places(spark, name):
    html, expected = IMAGES[name]
    assert contents(spark, [(name, html)])[name][1] == expected


def test_site_image_rule(spark):
    html = (
        '<meta property="og:image" content="o"><div style="x;text-align: center"><img src="/public/images/a.png"></div>'
    )
    got = contents(spark, [("https://x.developpez.com/1", html), ("https://other/1", html)])
    assert got["https://x.developpez.com/1"][1] == "/public/images/a.png"
    assert got["https://other/1"][1] == "o"


def test_summary_replaces_missing_content(spark):
    entries = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "link string, summary string")
    content = spark.createDataFrame([("a", "text", None), ("b", "", None)], "url string, content string, image_url string")
    got = {r["link"]: r["content"] for r in attach_content(entries, content).collect()}
    assert got == {"a": "text", "b": "s", "c": "s"}


def test_entry_image_preference(spark):
    img = lambda name: f'<img src="https://h/{name}.jpg">'
    rows = [
        ("l1", "Actualité : t", img("s"), img("c"), ["https://h/m"], None),
        ("l2", "t", img("logo"), img("c"), ["https://h/m"], None),
        ("l3", "t", None, None, ["https://h/m"], ["https://h/th"]),
        ("l4", "t", None, None, ["https://h/logo"], ["https://h/th"]),
        ("l5", "t", None, None, None, None),
        ("https://clubic.com/6", "t", None, None, None, None),
        ("https://clubic.com/7", "t", None, None, None, None),
        ("l8", "t", None, None, None, None),
    ]
    entries = spark.createDataFrame(
        rows, "link string, title string, summary string, content string, media_content array<string>, media_thumbnail array<string>"
    )
    cache = spark.createDataFrame([("l5", "https://h/cached")], "link string, image_url string")
    scraped = spark.createDataFrame(
        [("https://clubic.com/6", "https://h/scraped"), ("https://clubic.com/7", "https://h/logo"), ("l8", "https://h/x")],
        "link string, image_url string",
    )
    got = {r["link"]: (r["title"], r["image_url"]) for r in entry_image(entries, cache, scraped).collect()}
    assert got["l1"] == ("t", "https://h/s.jpg")
    assert [got[k][1] for k in ("l2", "l3", "l4", "l5")] == ["https://h/c.jpg", "https://h/m", "https://h/th", "https://h/cached"]
    assert got["https://clubic.com/6"][1] == "https://h/scraped"
    assert got["https://clubic.com/7"][1] is None and got["l8"][1] is None


def test_rewrite_and_override(spark):
    articles = spark.createDataFrame(
        [("JVC", "a", "1"), ("JVC", "b", "2"), ("X", "a", "3"), ("JVC", "", "4"), ("JVC", None, "5")],
        "source string, image_url string, link string",
    )
    rewrites = spark.createDataFrame([("a", "new")], "image_url string, new_url string")
    got = sorted((r["source"], r["image_url"] or "-") for r in rewrite_image(articles, rewrites).collect())
    assert got == [("JVC", "-"), ("JVC", "-"), ("JVC", "b"), ("JVC", "new"), ("X", "a")]

    pages = spark.createDataFrame([("https://jeuxvideo.com/1", "p"), ("https://h/1", "p")], "url string, image_url string")
    entries = spark.createDataFrame(
        [("https://jeuxvideo.com/1", 2, "e2", True), ("https://jeuxvideo.com/1", 1, "e1", True),
         ("https://jeuxvideo.com/1", 0, "e0", False), ("https://h/1", 0, "e", True)],
        "link string, pos int, image_url string, is_site_enclosure boolean",
    )
    got = {r["url"]: r["image_url"] for r in override_image(pages, entries).collect()}
    assert got == {"https://jeuxvideo.com/1": "e1", "https://h/1": "p"}
