"""Article text and picture candidates of a page: the one Arrow UDF of the package.

Spark has no HTML parser, so a single streaming pass over each page gathers what the
native expressions in this module then decide on.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import CONSENT_BANNERS, clean_content
from gazette.functions.urls import PATH_RULE_SITE, valid_page_image

# Where the article text is looked for, in order (tag, class or itemprop).
CONTENT_PLACES = [
    ("tag", "article"),
    ("class", "article-content"),
    ("class", "post-content"),
    ("itemprop", "articleBody"),
    ("class", "entry-content"),
]
# Where the main picture is looked for, in order.
IMAGE_PLACES = [
    ("property", "og:image"),
    ("name", "twitter:image"),
    ("in class", "article-featured-image"),
    ("in class", "post-thumbnail"),
    ("in tag", "article"),
    ("in class", "entry-content"),
    ("own class", "wp-post-image"),
    ("in tag", "figure"),
    ("in class", "main-image"),
    ("in class", "featured-image"),
]
# The centred block and image path of the site with rules of its own.
CENTRED = "text-align: center"
SITE_IMAGE_PATH = "/public/images/"

_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
_HIDDEN = frozenset(["script", "style", "template"])

_FIELDS = ["main_text", "page_text", "site_image", "placed_image", "images"]
_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _FIELDS[:-1]]
    + [T.StructField(_FIELDS[-1], T.ArrayType(T.StringType()))]
)


class _PageScan(HTMLParser):
    """Collects text per content place and pictures per image place in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, set]] = []
        self.data: list[str] = []
        self.page: list[str] = []
        self.place_text: dict[int, list[str]] = {}
        self.place_depth: dict[int, int] = {}
        self.placed: dict[int, str | None] = {}
        self.site_image: str | None = None
        self.images: list[str] = []

    def flush(self) -> None:
        text = "".join(self.data)
        self.data.clear()
        if not text or any(tag in _HIDDEN for tag, _, _ in self.open):
            return
        self.page.append(text)
        stripped = text.strip()
        if stripped:
            for place in self.place_depth:
                self.place_text[place].append(stripped)

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        values = {name: value or "" for name, value in attrs}
        classes = set(values.get("class", "").split())
        if tag == "img":
            self.see_image(values, classes)
        if tag == "meta":
            for place, (kind, wanted) in enumerate(IMAGE_PLACES):
                if kind in ("property", "name") and values.get(kind) == wanted:
                    self.placed.setdefault(place, values.get("content") or None)
        for place, (kind, wanted) in enumerate(CONTENT_PLACES):
            found = (
                tag == wanted
                if kind == "tag"
                else wanted in classes
                if kind == "class"
                else values.get(kind) == wanted
            )
            if found and place not in self.place_text:
                self.place_text[place] = []
                if tag not in _VOID:
                    self.place_depth[place] = len(self.open)
        if tag not in _VOID:
            self.open.append((tag, values, classes))

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        depth = max((i for i, (name, _, _) in enumerate(self.open) if name == tag), default=None)
        if depth is None:
            return
        del self.open[depth:]
        self.place_depth = {p: d for p, d in self.place_depth.items() if d < depth}

    def see_image(self, values: dict, classes: set) -> None:
        source = values.get("src") or None
        if source:
            self.images.append(source)
        for place, (kind, wanted) in enumerate(IMAGE_PLACES):
            if (
                (kind == "own class" and wanted in classes)
                or (kind == "in tag" and any(t == wanted for t, _, _ in self.open))
                or (kind == "in class" and any(wanted in c for _, _, c in self.open))
            ):
                self.placed.setdefault(place, source)
        if self.site_image is None and source and SITE_IMAGE_PATH in source:
            if any(t == "div" and CENTRED in v.get("style", "") for t, v, _ in self.open):
                self.site_image = source

    def result(self) -> tuple:
        self.flush()
        main = " ".join(self.place_text[min(self.place_text)]) if self.place_text else None
        placed = next((self.placed[p] for p in sorted(self.placed) if self.placed[p]), None)
        # the whole-page text only matters when the article text can clean to nothing
        keep_page = not main or "<" in main or any(first in main for first, _ in CONSENT_BANNERS)
        page = "".join(self.page) if keep_page else None
        return main, page, self.site_image, placed, self.images


@F.pandas_udf(_SCHEMA)
def scan_page(html: pd.Series) -> pd.DataFrame:
    """Text and picture candidates of each page; a page not fetched gives nulls."""
    rows = []
    for page in html:
        if page is None:
            rows.append((None, None, None, None, None))
            continue
        scan = _PageScan()
        scan.feed(page)
        scan.close()
        rows.append(scan.result())
    return pd.DataFrame(rows, columns=_FIELDS, dtype=object)


def article_text(scan: Column) -> Column:
    """Cleaned article text, the cleaned whole page when that is empty, null if not fetched."""
    main = F.when(scan["main_text"].isNotNull(), clean_content(scan["main_text"]))
    page = F.when(scan["page_text"].isNotNull(), clean_content(scan["page_text"]))
    return F.coalesce(F.nullif(main, F.lit("")), page, main)


def main_image(scan: Column, url: Column) -> Column:
    """Main picture: the site's own rule, then the ordered places (unchecked), then the
    first picture anywhere that passes the page rule."""
    own = F.when(
        url.contains(PATH_RULE_SITE) & valid_page_image(scan["site_image"]), scan["site_image"]
    )
    first_valid = F.get(F.filter(scan["images"], valid_page_image), F.lit(0))
    return F.coalesce(own, scan["placed_image"], first_valid)
