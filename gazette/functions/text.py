"""Text cleaning, truncation and chunking as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.common import let

# The characters Python's str.split() treats as white space.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Consent banners, from their first words to their last ones.
CONSENT_BANNERS = [
    ("Ce contenu est bloqué", "Gérer mes choix"),
    ("Les informations recueillies sont destinées", "politique Cookies"),
    ("En poursuivant votre navigation", "cookies"),
    ("Vous gardez la possibilité", "tout moment"),
]

# Quotes that become an apostrophe (curly quotes are left alone).
QUOTES = '"«»'

# The title prefix to drop, the cut mark and the mark of a capped text.
TITLE_PREFIX = "Actualité : "
ELLIPSIS = "..."
CAPPED_MARK = "... (contenu tronqué)"


def collapse_whitespace(c: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.btrim(F.regexp_replace(c, WHITESPACE + "+", " "), F.lit(" "))


def strip_whitespace(c: Column) -> Column:
    """White space removed at both ends only."""
    return F.regexp_replace(c, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def clean_content(c: Column) -> Column:
    """Drop tags and consent banners, collapse white space; null becomes empty."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for first, last in CONSENT_BANNERS:
        text = F.regexp_replace(text, f"(?s){first}.*?{last}", "")
    return collapse_whitespace(text)


def clean_quotes(c: Column) -> Column:
    """Straight and French double quotes become apostrophes; null becomes empty."""
    return F.translate(F.coalesce(c, F.lit("")), QUOTES, "'" * len(QUOTES))


def clean_title(c: Column) -> Column:
    """Remove the first occurrence of the news prefix."""
    at = F.instr(c, TITLE_PREFIX)
    rest = F.substr(c, at + F.lit(len(TITLE_PREFIX)))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), rest)).otherwise(c)


def truncate_words(c: Column, limit: int = 2000) -> Column:
    """Cut at the last space that leaves room for the ellipsis; short text is unchanged."""
    head = F.substring(c, 1, limit - len(ELLIPSIS))
    tail = F.instr(F.reverse(head), " ")
    kept = F.when(tail > 0, F.substr(head, F.lit(1), F.length(head) - tail)).otherwise(head)
    return F.when(F.length(c) > limit, F.concat(kept, F.lit(ELLIPSIS))).otherwise(c)


def chunk_words(c: Column, limit: int = 2000) -> Column:
    """Pack whole words greedily into chunks; every word counts one separator.

    On text with single spaces the longest run of words below ``limit`` characters is
    exactly one greedy regex match, so no per-word lambda is needed. A word of ``limit``
    characters or more stands alone, and one at the very start is preceded by an empty
    chunk.
    """
    pattern = rf"(?s)([^ ]{{{limit},}}|.{{1,{limit - 1}}})(?: |\z)"
    text = collapse_whitespace(F.coalesce(c, F.lit("")))
    chunks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    blank = F.array(F.lit(""))

    def lead(cs: Column) -> Column:
        oversize = F.length(F.get(cs, F.lit(0))) >= limit
        return F.when(oversize, F.concat(blank, cs)).otherwise(cs)

    return let(chunks, lead)


def cap_chunks(chunks: Column, cap: int = 10) -> Column:
    """Keep the first ``cap`` chunks; the last one kept then carries the cut mark."""

    def capped(cs: Column) -> Column:
        marked = F.concat(F.get(cs, F.lit(cap - 1)), F.lit(CAPPED_MARK))
        head = F.slice(cs, 1, cap - 1)
        return F.when(F.size(cs) > cap, F.concat(head, F.array(marked))).otherwise(cs)

    return let(chunks, capped)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def topic_id(title: Column, content: Column) -> Column:
    """Identifier of an exact topic: md5 of title, space, content."""
    missing = F.lit("None")
    return F.md5(
        F.concat(F.coalesce(title, missing), F.lit(" "), F.coalesce(content, missing))
    )
