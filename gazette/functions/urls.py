"""URL predicates: image validity, domain routing and enclosure choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a picture as page decoration.
DECORATION_WORDS = [
    "logo",
    "logos",
    "favicon",
    "fzn",
    "header",
    "footer",
    "icon",
    "banner",
    "-min.png",
    "site-icon",
    "site-logo",
    "brand",
]
# Icon sizes and icon file endings.
ICON_SIZES = ["16x16", "32x32", "64x64"]
ICON_SUFFIXES = [".ico", ".svg"]
# The site whose image paths have rules of their own.
PATH_RULE_SITE = "developpez.com"
PATH_RULE_ACCEPT = "/public/images/"
PATH_RULE_REJECT = "/images/logos/"
# Domains whose feeds carry no usable picture.
SCRAPED_DOMAINS = ["fredzone.org", "clubic.com", "*.developpez.com"]
# Fixed value: the site whose enclosure image wins over the page image.
ENCLOSURE_SITE = "jeuxvideo.com"


def _any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def valid_feed_image(url: Column) -> Column:
    """Picture rule for feed images: any case, no icon sizes or icon files."""
    suffixes = "(?:" + _any_of(ICON_SUFFIXES) + r")\z"
    pattern = "|".join([_any_of(DECORATION_WORDS), _any_of(ICON_SIZES), suffixes])
    return F.coalesce((url != "") & ~F.lower(url).rlike(pattern), F.lit(False))


def valid_page_image(url: Column) -> Column:
    """Picture rule for page images: case-sensitive, with the site's path rules first."""
    on_site = url.contains(PATH_RULE_SITE)
    verdict = (
        F.when(url == "", F.lit(False))
        .when(on_site & url.contains(PATH_RULE_ACCEPT), F.lit(True))
        .when(on_site & url.contains(PATH_RULE_REJECT), F.lit(False))
        .otherwise(~url.rlike(_any_of(DECORATION_WORDS)))
    )
    return F.coalesce(verdict, F.lit(False))


def net_location(url: Column) -> Column:
    """Host with any user and port, empty when the URL has none."""
    return F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def needs_scraping(url: Column) -> Column:
    """Whether the link's network location is on the scraped list (exact, or ``*.`` suffix)."""
    host = net_location(url)
    hit = host.isin([d for d in SCRAPED_DOMAINS if not d.startswith("*.")])
    for domain in SCRAPED_DOMAINS:
        if domain.startswith("*."):
            hit = hit | host.endswith(domain[1:])
    return F.coalesce(hit, F.lit(False))


def is_web_url(url: Column) -> Column:
    """A string that starts with http:// or https://."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def enclosure_image(enclosures: Column) -> Column:
    """URL (else href) of the first enclosure with an image type."""
    first = F.get(F.filter(enclosures, lambda e: e["type"].startswith("image/")), F.lit(0))
    return F.coalesce(F.nullif(first["url"], F.lit("")), first["href"])


def snippet_image(html: Column) -> Column:
    """First acceptable http(s) picture of an HTML snippet."""
    pattern = r"<img[^>]+src=['\"](https?://[^'\"]+)['\"]"
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.get(F.filter(found, valid_feed_image), F.lit(0))
