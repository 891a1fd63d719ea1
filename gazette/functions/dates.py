"""Feed dates as UTC timestamps without zone, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.common import let, literal_map

# Month names of mail dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Named zones of mail dates, as minutes east of UTC.
ZONES = {
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "EST": -300,
    "EDT": -240,
    "CST": -360,
    "CDT": -300,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
}

_MAIL_DATE = (
    r"\A(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
)
_ZONE = r"(Z|[A-Z]{2,3}|[+-]\d{2}:?\d{2})\z"


def _offset_minutes(text: Column) -> Column:
    """Minutes east of UTC written at the end of a date that has a time; otherwise 0."""
    zones = literal_map({name: str(east) for name, east in ZONES.items()})

    def minutes(zone: Column) -> Column:
        digits = F.regexp_replace(zone, "[+:-]", "")
        size = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        signed = F.when(zone.startswith("-"), -size).otherwise(size)
        return F.coalesce(F.element_at(zones, zone).cast("int"), signed, F.lit(0))

    zone = F.when(text.contains(":"), F.regexp_extract(text, _ZONE, 1))
    return let(F.coalesce(zone, F.lit("")), minutes)


def _parse(text: Column) -> Column:
    part = [F.regexp_extract(text, _MAIL_DATE, i) for i in range(1, 7)]
    months = literal_map({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)})
    mail = F.concat(
        part[2], F.lit("-"), F.element_at(months, F.lower(part[1])), F.lit("-"),
        F.lpad(part[0], 2, "0"), F.lit("T"), F.lpad(part[3], 2, "0"), F.lit(":"), part[4],
        F.lit(":"), F.coalesce(F.nullif(part[5], F.lit("")), F.lit("00")),
    )
    iso = F.regexp_replace(text, r"(:\d{2})(?:\.\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?\z", "$1")
    wall = F.when(text.rlike(_MAIL_DATE), mail).when(text.rlike(r"\A\d{4}"), iso)
    return F.timestamp_add("MINUTE", -_offset_minutes(text), wall.try_cast("timestamp_ntz"))


def parse_feed_date(c: Column) -> Column:
    """Mail-style or ISO date string to a UTC timestamp without zone, else null.

    The wall-clock part is read on its own and the written offset subtracted, so no
    step depends on the session time zone. Fractions of a second are dropped.
    """
    return let(F.btrim(c), _parse)


def first_feed_date(fields: Column) -> Column:
    """The first of an array of date fields that can be read."""
    parsed = F.transform(fields, lambda f: F.when(f.isNotNull(), parse_feed_date(f)))
    return F.get(F.filter(parsed, lambda d: d.isNotNull()), F.lit(0))


def iso_date(c: Column) -> Column:
    """ISO string of a timestamp, null stays null."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
