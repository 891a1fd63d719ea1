"""Personal data in texts: patterns propose spans, checksums confirm them, context words score them.

Five kinds have a pattern each: e-mail and IP addresses, payment cards, telephone numbers with a
country code, and, beside these base kinds, bank accounts (IBAN), French social security numbers
and telephone numbers without a country code. A proposal is tested by what its kind has to
offer: the range of the parts, the number of digits, Luhn's sum, the remainder modulo 97. Its
score is the kind's own, raised when a checksum confirms it and when a word that goes with the
kind stands near. Base spans stay whatever their score; others need ACCEPTED, and give way to base spans
and to proposals of a kind before theirs that they overlap.

All patterns but the address one are looked for only in runs of digits and the signs between
them; these, like the address, are found in one pass whose time grows with the text, whatever it holds.

Defined results: null text is empty; a text without spans has an empty list; offsets count code
points; of one kind the leftmost proposals that don't overlap are tested, and one that fails is not
tried again in part; rows with equal or null ids are separate rows; columns other than doc_id and text are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.tables import table

KINDS = ("email", "ip", "card", "phone", "iban", "nir")
BASE = KINDS[:4]

# Lengths of bank account numbers by country, from the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
}

#: Score of a kind's proposal before anything speaks for it.
PRIORS = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "nir": 0.4, "local": 0.4}
CONFIRMED, NEAR = 0.3, 0.25
#: Least score of a span beyond the base ones.
ACCEPTED = 0.6
#: Code points before and after a proposal in which a context word counts.
BEFORE, AFTER = 40, 20
#: Words that go with a kind, as the beginning of a word of a text with A-Z in lower case.
CONTEXT = {
    "email": "e-?mail|mail|courriel|correo|contact|kontakt",
    "ip": "ip|server|serveur|servidor|host|address|adresse",
    "card": "card|carte|karte|tarjeta|visa|mastercard|amex|credit|kredit",
    "phone": "tel|phone|tél|call|fax|mobil|portable|numero|rufnummer|appele",
    "iban": "iban|bank|banque|banco|konto|account|compte|cuenta",
    "nir": "nir|sécu|secu|social|insee|assur",
}

_REGION = re.compile(r"[0-9+(][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
NIR = r"\b[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b"
LOCAL = r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b|\b0[1-9](?:[ .-]?[0-9]{2}){4}\b"
_IBAN, _NIR, _LOCAL = (re.compile(p, re.ASCII) for p in (IBAN, NIR, LOCAL))
_NEAR = {kind: re.compile(rf"(?:^|[^a-z])(?:{words})") for kind, words in CONTEXT.items()}
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPANS = "doc_id long, spans array<struct<kind string, start int, end int, score double, base boolean, value string>>"


class Span(NamedTuple):
    """A found span; ``end`` is the code point after it."""

    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """Whether the last digit is the one that Luhn's rule asks for."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number leaves 1 modulo 97, its first four signs put last and letters counted from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, last, at = 0, 0, text.find("@")
    while at >= 0:
        # the name is the run of its signs just before, which no other @ can be part of
        start = at
        while start > max(free, last) and text[start - 1] in _NAME:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        last = at + 1
        at = text.find("@", max(free, last))


def _fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _account(text: str, m: re.Match) -> int | None:
    """End of a confirmed account number at the beginning of a proposal."""
    length = IBAN_LENGTHS.get(m[0][:2], 99)
    places = [i for i, c in enumerate(m[0]) if c != " "]
    if len(places) < length:
        return None
    end = places[length - 1] + 1
    after = text[m.start() + end : m.start() + end + 1]
    if (after.isascii() and after.isalnum()) or not mod97(m[0][:end].replace(" ", "")):
        return None
    return m.start() + end


def find(text: str | None) -> list[Span]:
    """Spans of a text by start, then kind."""
    text = text or ""
    found = [("email", a, b, False, True) for a, b in _emails(text)]
    used = 0
    for region in _REGION.finditer(text):
        a, b = region.span()
        m = _IBAN.match(text, a - 2) if a - 2 >= used else None
        if m:
            used = m.end()
            end = _account(text, m)
            if end:
                found.append(("iban", m.start(), end, True, False))
        if b - a < 7:  # shorter than any address or number
            continue
        for m in _IP.finditer(text, a, b):
            if all(map(_fits, m[0].split("."))):
                found.append(("ip", *m.span(), False, True))
        for m in _CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), True, True))
        for m in _PHONE.finditer(text, a, b):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span(), False, True))
        # one sign more, by which a pattern sees whether the word goes on
        for m in _NIR.finditer(text, a, b + 1):
            digits = m[0].replace(" ", "")
            if int(digits[13:]) == 97 - int(digits[:13]) % 97:
                found.append(("nir", *m.span(), True, False))
        for m in _LOCAL.finditer(text, a, b + 1):
            found.append(("local", *m.span(), False, False))
    return _kept(text, found)


def _kept(text: str, found: list[tuple[str, int, int, bool, bool]]) -> list[Span]:
    rows, taken = [], [(a, b) for _, a, b, _, own in found if own]
    for kind, a, b, confirmed, own in found:
        shown = "phone" if kind == "local" else kind
        around = text[max(0, a - BEFORE) : a] + " " + text[b : b + AFTER]
        near = _NEAR[shown].search(around.translate(_SMALL)) is not None
        score = round(min(1.0, PRIORS[kind] + CONFIRMED * confirmed + NEAR * near), 2)
        rows.append((kind, Span(shown, a, b, score, own)))
    out = [s for _, s in rows if s.base]
    for kind in ("iban", "nir", "local"):
        own = [s for k, s in rows if k == kind]
        if own:
            taken = _merged(taken)
            out += [s for s in own if s.score >= ACCEPTED and not _meets(taken, s)]
            taken += [(s.start, s.end) for s in own]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _meets(taken: list[tuple[int, int]], span: Span) -> bool:
    at = bisect(taken, (span.end,)) - 1
    # the last span that begins before the end reaches furthest, since none overlap
    return at >= 0 and span.start < taken[at][1]


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets: list[int] = [0]
            rows: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py()
                rows += [(*s, text[s.start : s.end]) for s in find(text)]
                offsets.append(len(rows))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            names = ["kind", "start", "end", "score", "base", "value"]
            spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SPANS)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap the first is replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        new = F.struct(F.concat(done["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= done["at"], new).otherwise(done)

    return F.aggregate(spans, start, step, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all its spans."""
    base = F.filter("spans", lambda s: s["base"])
    rows = found(table(spark, sf_dir, "documents")).select("doc_id", "spans", base.alias("b"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *map(counted, BASE), F.sha2(_listed(F.col("b")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _sql_spans(name: str, pattern: str, test: str) -> str:
    """Tested proposals of a pattern: the pieces between its matches tell where each of them begins."""
    return f"""{name}_m as (
  select row_id, text, unnest(string_split_regex(text, '{pattern}')) as piece,
         unnest(list_append(regexp_extract_all(text, '{pattern}'), null)) as m,
         generate_subscripts(string_split_regex(text, '{pattern}'), 1) as i from t),
{name}_p as (
  select row_id, text, m, (sum(length(piece)) over w + coalesce(sum(length(m)) over w, 0) - coalesce(length(m), 0))::bigint as a
  from {name}_m window w as (partition by row_id order by i rows unbounded preceding)),
{name} as (select row_id, text, m, a, a + length(m) as b, replace(replace(m, ' ', ''), '-', '') as d
  from {name}_p where m is not null and {test})"""


def _sql_score(kind: str, prior: float) -> str:
    return (
        f"{prior} + case when regexp_matches(translate(substr(text, greatest(a - {BEFORE}, 0) + 1, a - greatest(a - {BEFORE}, 0)) || ' '"
        f" || substr(text, b + 1, {AFTER}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        f" '(?:^|[^a-z])(?:{CONTEXT[kind]})') then {NEAR} else 0 end >= {ACCEPTED} - 0.001"
    )


def _sql_digits(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda c: c::int)"


def _sql_remainder(x: str) -> str:
    """A long number modulo 97, digit by digit."""
    return f"list_reduce({_sql_digits(x)}, lambda r, c: (r * 10 + c) % 97)"


_SQL_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when (length({d}) - i) % 2 = 0 then substr({d}, i, 1)::int else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr({d}, i, 1)::int + 1] end)) % 10 = 0"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LENGTHS = "map {" + ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTHS.items()) + "}"
_LETTERS = "list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: case when x between 'A' and 'Z' then (ascii(x) - 55)::varchar else x end)"

SQL = "with t as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),\n" + ",\n".join(
    [
        _sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "not regexp_matches(m, '(^|\\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(\\.|$)')"),
        _sql_spans("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) between 14 and 19 and {_SQL_LUHN.format(d=_DIGITS)}"),
        _sql_spans("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15"),
        _sql_spans("iban_x", IBAN, "true"),
        f"""iban_y as (select row_id, text, a, m, d, {_LENGTHS}[substr(m, 1, 2)] as n from iban_x),
iban_z as (select row_id, text, a, substr(d, 1, n) as c,
    a + list_filter(range(1, length(m) + 1), lambda e: length(replace(substr(m, 1, e), ' ', '')) = n)[1] as b from iban_y where length(d) >= n),
iban as (select row_id, text, a, b from iban_z where not regexp_matches(substr(text, b + 1, 1), '[A-Za-z0-9]')
    and {_sql_remainder(f"array_to_string({_LETTERS}, '')")} = 1)""",
        _sql_spans("nir", NIR, f"substr(d, 14)::int = 97 - {_sql_remainder('substr(d, 1, 13)')}"),
        _sql_spans("loc", LOCAL, "true"),
    ]
) + f""",
base as (select 'email' as kind, 1 as k, row_id, a, b from email union all select 'ip', 2, row_id, a, b from ip
  union all select 'card', 3, row_id, a, b from card union all select 'phone', 4, row_id, a, b from phone),
more as (
  select 'iban' as kind, 5 as k, 1 as turn, row_id, a, b, {_sql_score('iban', PRIORS['iban'] + CONFIRMED)} as good from iban
  union all select 'nir', 6, 2, row_id, a, b, {_sql_score('nir', PRIORS['nir'] + CONFIRMED)} from nir
  union all select 'phone', 4, 3, row_id, a, b, {_sql_score('phone', PRIORS['local'])} from loc),
added as (select kind, k, row_id, a, b from more x where good
  and not exists (select 1 from base y where y.row_id = x.row_id and y.a < x.b and x.a < y.b)
  and not exists (select 1 from more y where y.row_id = x.row_id and y.turn < x.turn and y.a < x.b and x.a < y.b)),
o as (select row_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
    count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as listed from base group by row_id),
s as (select row_id, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as listed
  from (from base union all from added) group by row_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
  coalesce(n_phone, 0) as n_phone, sha256(coalesce(o.listed, '')) as base_sha256, coalesce(s.listed, '') as spans
from t left join o using (row_id) left join s using (row_id)"""
