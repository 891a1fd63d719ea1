from gazette.functions import urls as U

# url, accepted in feeds, accepted on pages
IMAGES = [
    ("https://h/a.jpg", True, True),
    ("https://h/LOGO.jpg", False, True),
    ("https://h/logo.jpg", False, False),
    ("https://h/pic32x32.jpg", False, True),
    ("https://h/a.svg", False, True),
    ("https://h/a.svg?x", True, True),
    ("https://h/a.SVG", False, True),
    ("https://h/x-min.png", False, False),
    ("https://h/x-minXpng", True, True),
    ("https://fzn/a", False, False),
    ("https://www.developpez.com/public/images/logo.png", False, True),
    ("https://www.developpez.com/images/logos/a.png", False, False),
    ("https://www.developpez.com/a.png", True, True),
    ("", False, False),
    (None, False, False),
]


def test_both_image_rules(evaluate):
    raw = [u for u, _, _ in IMAGES]
    assert evaluate(U.valid_feed_image, raw) == [f for _, f, _ in IMAGES]
    assert evaluate(U.valid_page_image, raw) == [p for _, _, p in IMAGES]


def test_scraping_compares_the_network_location(evaluate):
    raw = ["https://fredzone.org/x", "https://www.fredzone.org/x", "https://clubic.com:80/", "https://a.developpez.com?q",
           "https://developpez.com", "http://bad url", None]
    assert evaluate(U.needs_scraping, raw) == [True, False, False, True, False, False, False]


def test_web_url(evaluate):
    raw = ["http://a", "https://a", "HTTP://a", " http://a", "ftp://a", "", None]
    assert evaluate(U.is_web_url, raw) == [True, True, False, False, False, False, False]


def test_first_image_enclosure(evaluate):
    kind = "array<struct<type string, url string, href string>>"
    raw = [
        [("audio/mpeg", "a", None), ("image/png", "b", None), ("image/gif", "c", None)],
        [("image/png", "", "h")], [("image/png", None, None), ("image/gif", "c", None)], [(None, "a", None)], [], None,
    ]
    assert evaluate(U.enclosure_image, raw, kind) == ["b", "h", None, None, None, None]


def test_snippet_image_skips_decoration(evaluate):
    raw = ['<img src="https://h/logo.png"><img class=x src=\'https://h/a.jpg\'>', '<img src="/rel.jpg">', "", None]
    assert evaluate(U.snippet_image, raw) == ["https://h/a.jpg", None, None, None]
