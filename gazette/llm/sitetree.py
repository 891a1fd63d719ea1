"""Main text of pages by site style trees.

Pages of one host are merged into a tree of styles: a node is the chain of elements, with class
and id, from the body down. For every node the tree counts, over the host's distinct pages, how
often each presentation (sequence of child styles) and each content (text) occurs.
Nodes whose counts are spread evenly over many values are important; those that show the
same on page after page carry no information. The importance of a branch is the larger one of
the normalised entropies of its content and of its presentation, and branches below LEAST are
removed from each page. So is a branch or block whose text c of its m pages have, if 1 - log c / log m is below LEAST.

Inside article and main elements only containers go, with all they hold: elements that are neither headings nor
running text (TEXTS), whose content is that of everything below them, that MANY distinct pages have, and that hold no
h1 and more than headings. Headings and paragraphs that an article has of its own always stay, however many pages have the same. An
article's containers all stay if nothing of it would be left.

Elements that say what they are need no counting: menus, footers, forms, comments and the like have no importance. A
container with a noise word beside others in a name, such as related-work, must reach SURE to stay. An
article or main element raises the importance of what it holds: what lies outside it on a page that has
one must reach SURE, on enough pages to know.

Pages are told apart by the two smallest hashes of their texts without noise (of article and main, if there are), so copies
with other adverts count once and copies with an edit here and there count as few. Cells of tables repeat by nature and stay.

Only counts are shuffled per host and style, added up before the shuffle; a host's page rows meet
its tree in a join that Spark can split. Of nodes seen on fewer than FEW distinct pages of a host too little is
known: they are kept, unless they lie outside the article or main element of their page. A page takes memory and time
in proportion to its length, however deeply its elements are nested.

Defined results: null or empty html has empty text; a null url is a host of its own; pages cut off
anywhere are read as far as they go; repeated rows are extracted each but count once in the tree;
an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Set
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.tables import keep, table

LEAST = 0.3
SURE = 0.6
FEW = 4
#: Distinct pages that must have a container before it can go from inside their article or main element.
MANY = 8
#: Counted values a task holds before it sends them on.
HELD = 200_000

# HTML elements by what they are.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noframes noembed iframe object svg math canvas audio video select textarea button title map datalist".split())
NOISE = frozenset("nav footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an article's text is made of.
TEXTS = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre summary address legend".split())
#: What a head may hold; any other element ends it.
HEAD = frozenset("title script style template noscript meta link base".split())
#: Their texts may repeat from page to page and still be what the page is about.
CELLS = frozenset("td th dt dd".split())
#: An element is noise whose class, id or role is one of these words, or made of them and AFFIXES only.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer header menu menubar modal nav navbar navigation newsletter notice notices notification paywall popup "
    "promo promotion recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary "
    "contentinfo discussion replies".split()
)
AFFIXES = frozenset(
    "area articles bar block bottom box button buttons container global google icon icons inner js link links list media posts "
    "section site slot stories top unit widgets wp wrap wrapper".split()
)
#: A new one of these closes an open one, up to the nearest element that may hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SPACE = re.compile(r"\s+")


class Node:
    """An element. Flags ending in ``_in`` hold for it or for one around it."""

    __slots__ = ("tag", "style", "key", "parent", "noise", "named", "doubt", "around", "main_in", "unseen_in", "noise_in", "doubt_in", "content", "texts", "headings", "title", "children")

    def __init__(self, tag: str, style: str, parent: Node | None, noise: bool = False, named: bool = False, doubt: bool = False) -> None:
        self.tag, self.style, self.parent = tag, style, parent
        self.noise, self.named, self.doubt, self.around = noise, named, doubt, False
        above = parent.key if parent else 0
        self.key = _hash(f"{above}/{style}") if style else above
        self.main_in = tag in MAIN or (parent is not None and parent.main_in)
        self.unseen_in = tag in UNSEEN or (parent is not None and parent.unseen_in)
        self.noise_in = self.doubt_in = False
        # hash and number of the texts below, those of headings among them, whether one is an h1
        self.content = self.texts = self.headings = 0
        self.title = False
        self.children: list[str] | None = None

    def container(self) -> bool:
        """Whether it may go from inside an article or main element."""
        inside = self.parent is not None and self.parent.main_in
        return bool(inside and self.style and self.tag not in TEXTS and not self.title and self.headings < self.texts)


class Page(HTMLParser):
    """Blocks ``(node, text)`` of a page in order, and its nodes, parents first.

    Noise is what an element is by its tag or by its whole class, id or role; of one that has a noise word beside
    others in a name there is doubt. Names of elements around the outermost article or main count for nothing, unless the
    page has main text elsewhere, as where comments are articles.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = [Node("#", "", None)]
        self.nodes: list[Node] = self.stack[:]
        self.open: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.found: list[tuple[Node, str]] = []
        self.words: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        self.stack.clear()
        self._inherit(True)
        if not any(n.main_in and not n.noise_in for n, _ in self.found):
            self._inherit(False)
        self.blocks = [(n, text) for n, text in self.found if not n.noise_in]
        self.has_main = any(n.main_in for n, _ in self.blocks)
        self._contents()

    def _inherit(self, names_around: bool) -> None:
        for node in self.nodes:
            above = node.parent
            named = node.named and (names_around or not node.around)
            node.noise_in = node.noise or named or (above is not None and above.noise_in)
            node.doubt_in = (node.doubt and not node.around) or (above is not None and above.doubt_in)

    def _contents(self) -> None:
        for node, text in self.blocks:
            node.content = _hash(f"{node.content}/{_hash(text)}")
            node.texts += 1
            node.headings += node.tag in HEADINGS
            node.title = node.title or node.tag == "h1"
        for node in reversed(self.nodes):
            above = node.parent
            if node.texts and above is not None:
                above.content = _hash(f"{above.content}/{node.content}")
                above.texts += node.texts
                above.headings += node.headings
                above.title = above.title or node.title

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.words)).strip()
        self.words.clear()
        if text:
            self.found.append((self.stack[self.open_blocks[-1]] if self.open_blocks else self.stack[0], text))

    def _up_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1].tag in BLOCKS:
                self._flush()
                self.open_blocks.pop()
            self.open[self.stack.pop().tag].pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack[-1].tag == "head" and tag not in HEAD:
            self._up_to(len(self.stack) - 1)
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.handle_data(" ")
            return
        if tag in BLOCKS:
            self._flush()
            # an open paragraph, with whatever inline elements it holds, ends at a block
            if self.open_blocks and self.stack[self.open_blocks[-1]].tag == "p":
                self._up_to(self.open_blocks[-1])
        if tag in CLOSES:
            closes, holds = CLOSES[tag]
            depth = self._last(closes)
            if depth > self._last(holds):
                self._up_to(depth)
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()
        parent = self.stack[-1]
        inside = parent.main_in
        hidden = "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style") or "", re.I) is not None
        noise = tag in NOISE or hidden or (tag == "header" and not inside)
        whole = doubt = False
        if tag not in {"html", "body", *MAIN}:
            for name in names + (named.get("role") or "").lower().split():
                said = {w for w in re.split(r"[^a-z]+", name) if w}
                if said & NOISE_WORDS:
                    # the header of an article holds its title
                    whole, doubt = whole or (said <= NOISE_WORDS | AFFIXES and not (inside and "header" in said)), True
        if tag in MAIN and not inside:
            around: Node | None = parent
            while around is not None and not around.around:
                around.around = True
                around = around.parent
        style = tag + "".join("." + re.sub(r"\d+", "#", n) for n in sorted(names)) if tag in BLOCKS else ""
        if style:
            if parent.children is None:
                parent.children = []
            parent.children.append(style)
            self.open_blocks.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        node = Node(tag, style, parent, noise, whole, doubt)
        self.stack.append(node)
        self.nodes.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # outside foreign elements the slash means nothing
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
        depth = self._last((tag,))
        if depth:
            self._up_to(depth)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].unseen_in:
            self.words.append(data)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def counted(pages: DataFrame) -> DataFrame:
    """Rows ``host, style, kind, value, page``: what the nodes of all pages show, per distinct page.

    Kinds: 0 texts, 1 sequences of child styles, 2 the page itself, with value 1 outside its article or main element and 2
    for containers inside.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: set = set()

        def out() -> pa.RecordBatch:
            host, style, kind, value, page = zip(*counts) if counts else ((),) * 5
            cols = [pa.array(host, pa.string()), pa.array(style, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(page, pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, names=["host", "style", "kind", "value", "page"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = Page(html or "")
                texts = {_hash(text) for node, text in tree.blocks if node.main_in or not tree.has_main}
                page = _hash("/".join(map(str, heapq.nsmallest(2, texts))))
                shown = {id(node): (node, _hash(text), int(tree.has_main)) for node, text in tree.blocks if not node.main_in}
                shown |= {id(node): (node, node.content, 2) for node in tree.nodes if node.texts and not node.noise_in and node.container()}
                for node, value, where in shown.values():
                    counts.add((host, node.key, 2, where, page))
                    counts.add((host, node.key, 0, value, page))
                    if node.children:
                        counts.add((host, node.key, 1, _hash(" ".join(node.children)), page))
                for node, text in tree.blocks:
                    if not node.main_in:
                        counts.add((host, node.key, 0, _hash(text), page))
                if len(counts) >= HELD:
                    yield out()
        yield out()

    return pages.select("host", "html").mapInArrow(count, "host string, style long, kind int, value long, page long")


def importance(counts: DataFrame) -> DataFrame:
    """One row ``_host, low, sure, repeated, doubtful`` for each host of which enough is known.

    ``low``: styles of low importance; ``sure``: those outside an article or main element that reach SURE; ``repeated``:
    style and text, joined by exclusive or, that are on too many of the style's pages; ``doubtful``: styles between LEAST and SURE. The importance of a branch is the
    entropy of its values over all their occurrences, divided by that of values that all differ.
    """
    values = keep(counts.distinct().groupBy("host", "style", "kind", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    nodes = values.groupBy("host", "style", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("value").alias("outside"))
    # -sum p log p = log n - (sum c log c) / n
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    page = F.col("kind") == 2
    branch = nodes.groupBy("host", "style").agg(
        F.max(F.when(~page, entropy)).alias("e"), F.max(F.when(page, F.col("n"))).alias("pages"), F.max(F.when(page, F.col("outside"))).alias("outside")
    )
    branch = keep(branch.where(F.col("pages") >= F.when(F.col("outside") == 2, MANY).otherwise(FEW)), "branches")
    level = F.when(F.col("e") < LEAST, 0).when((F.col("e") >= SURE) & (F.col("outside") == 1), 1)
    styles = branch.select("host", level.alias("level"), F.col("style").alias("key")).where("level IS NOT NULL")
    often = values.where((F.col("kind") == 0) & (F.col("n") >= FEW)).select(F.col("host").alias("_h"), F.col("style").alias("_s"), "value", "n")
    often = often.join(branch, (F.col("style") == F.col("_s")) & F.col("host").eqNullSafe(F.col("_h"))).where(1 - F.log("n") / F.log("pages") < LEAST)
    keys = styles.unionByName(often.select("host", F.lit(2).alias("level"), F.col("style").bitwiseXOR(F.col("value")).alias("key")))
    keys = keys.unionByName(branch.where((F.col("e") >= LEAST) & (F.col("e") < SURE)).select("host", F.lit(3).alias("level"), F.col("style").alias("key")))
    lists = [F.collect_list(F.when(F.col("level") == i, F.col("key"))).alias(name) for i, name in enumerate(("low", "sure", "repeated", "doubtful"))]
    return keys.groupBy(F.col("host").alias("_host")).agg(*lists)


def main_text(html: str, low: Set[int] = frozenset(), sure: Set[int] = frozenset(), repeated: Set[int] = frozenset(), doubtful: Set[int] = frozenset()) -> str:
    """Blocks of a page that are left without noise and what the host's tree takes away, one a line."""
    page = Page(html)

    def goes(node: Node, value: int) -> bool:
        return node.key in low or (node.doubt_in and node.key in doubtful) or node.key ^ value in repeated

    gone: set[int] = set()
    for node in page.nodes:
        if id(node.parent) in gone or (node.container() and goes(node, node.content)):
            gone.add(id(node))
    kept = []
    for node, text in page.blocks:
        if node.main_in:
            stays = id(node) not in gone
        else:
            stays = (not page.has_main or node.key in sure) and (not goes(node, _hash(text)) or (node.tag in CELLS and node.key not in low))
        if stays:
            kept.append((node, text))
    if page.has_main and not any(node.main_in for node, _ in kept):
        kept = [(node, text) for node, text in page.blocks if node.main_in]
    return "\n".join(text for _, text in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Rows ``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.regexp_extract("url", r"(?s)^[^:]*://([^/?#]*)", 1).alias("host"), "html")
    # written first, so that its size is known when the join with the pages is planned
    known = keep(importance(counted(rows)), "styles")
    joined = rows.join(known, rows["host"].eqNullSafe(known["_host"]), "left").select("page_id", "url", "html", "low", "sure", "repeated", "doubtful")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 7)))
            texts = [main_text(html or "", *(frozenset(x or ()) for x in known)) for html, *known in rows]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
