"""HTML character references decoded by native expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.common import let, literal_map
from gazette.functions.text import strip_whitespace

# One character reference: decimal, hexadecimal, or a name with or without semicolon.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# Names that are valid without a semicolon, longest first so that the longest prefix wins.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)

# The references nearly all pages are made of.
_COMMON = {
    "&amp;": "&",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
}


# A map is searched from its start, so the names of Western letters and signs, which make
# up nearly every other reference, have a small map of their own.
_WESTERN = {n: v for n, v in html5.items() if len(v) == 1 and ord(v) < 256}
_OTHER = {n: v for n, v in html5.items() if n not in _WESTERN}


def _named(name: Column) -> Column:
    return F.coalesce(
        F.element_at(literal_map(_WESTERN), name), F.element_at(literal_map(_OTHER), name)
    )


def _legacy_bytes() -> Column:
    """Code points 128-159 as browsers read them: windows-1252, undefined bytes as they are."""
    codes = range(0x80, 0xA0)
    return literal_map(
        {str(n): bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in codes}
    )


def _from_code_point(code: Column) -> Column:
    """Text of a code point; a null code is a number too large to read."""
    replacement = F.lit("�")
    unreadable = (
        code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    )
    # control characters and non-characters give nothing
    dropped = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    encoded = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return (
        F.when(unreadable, replacement)
        .when(code.between(0x80, 0x9F), F.element_at(_legacy_bytes(), code.cast("string")))
        .when(dropped, F.lit(""))
        .otherwise(F.decode(encoded, "UTF-32"))
    )


def _decode_reference(ref: Column) -> Column:
    decimal = F.regexp_extract(ref, r"\A&#([0-9]+)", 1).try_cast("bigint")
    digits = F.regexp_extract(ref, r"\A&#[xX]0*([0-9a-fA-F]*)", 1)
    hexadecimal = F.when(F.length(digits) > 8, F.lit(None)).otherwise(
        F.conv(F.concat(F.lit("0"), digits), 16, 10).try_cast("bigint")
    )
    body = F.substr(ref, F.lit(2))
    bare_names = {n: html5[n] for n in _BARE_NAMES}
    prefix = F.regexp_extract(body, r"\A(?:" + "|".join(_BARE_NAMES) + ")", 0)
    bare = let(
        prefix,
        lambda p: F.when(
            p != "", F.concat(F.element_at(literal_map(bare_names), p), F.substr(body, F.length(p) + 1))
        ),
    )
    named = F.coalesce(_named(body), bare, ref)
    decoded = F.when(ref == "&amp;", F.lit("&"))
    for name, text in _COMMON.items():
        decoded = decoded.when(ref == name, F.lit(text))
    return (
        decoded.when(ref.rlike(r"\A&#[0-9]"), let(decimal, _from_code_point))
        .when(ref.rlike(r"\A&#[xX]"), let(hexadecimal, _from_code_point))
        .otherwise(named)
    )


def unescape_entities(c: Column) -> Column:
    """Decode every character reference once; text without ``&`` takes no work."""
    refs = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    between = F.split(c, _REFERENCE, -1)
    decoded = F.concat(F.transform(refs, _decode_reference), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, decoded, lambda a, b: F.concat(a, b)), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def unescape_text(c: Column) -> Column:
    """Decode references, turn left-over numeric ones into an apostrophe, drop control
    characters other than newline and tab, and strip the ends; null becomes empty."""
    text = unescape_entities(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"&#\p{Nd}+;", "'")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")
    return strip_whitespace(text)
