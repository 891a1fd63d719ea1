import datetime as dt

import pytest

from gazette.functions.dates import first_feed_date, iso_date, parse_feed_date

CASES = {
    "Mon, 01 Jan 2024 10:00:00 GMT": "2024-01-01T10:00:00",
    "Mon, 01 Jan 2024 10:00:00 +0100": "2024-01-01T09:00:00",
    "1 Jan 2024 10:00 -0530": "2024-01-01T15:30:00",
    "Monday, 1 January 2024 10:00:00 EST": "2024-01-01T15:00:00",
    "Tue, 02 Jul 2024 10:00:00 EDT": "2024-07-02T14:00:00",
    "2024-01-01T10:00:00Z": "2024-01-01T10:00:00",
    "2024-01-01T10:00:00.750+02:00": "2024-01-01T08:00:00",
    "2024-01-01T10:00": "2024-01-01T10:00:00",
    "2024-03-31T02:30:00": "2024-03-31T02:30:00",
    "2024-01-01": "2024-01-01T00:00:00",
    "31 Feb 2024 10:00:00 GMT": None,
    "yesterday": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, evaluate, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = evaluate(lambda c: parse_feed_date(c).cast("string"), list(CASES))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [g and g.replace(" ", "T") for g in got] == list(CASES.values())


def test_first_readable_field_wins(evaluate):
    rows = [["junk", None, "2024-01-02"], [None, None], ["2024-05-06", "2024-01-02"]]
    got = evaluate(first_feed_date, rows, "array<string>")
    assert got == [dt.datetime(2024, 1, 2), None, dt.datetime(2024, 5, 6)]


def test_iso_date(evaluate):
    assert evaluate(iso_date, [dt.datetime(2024, 1, 2, 3, 4, 5), None], "timestamp_ntz") == ["2024-01-02T03:04:05", None]
