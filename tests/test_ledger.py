import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import records as R
from gazette.operators import retention as N
from gazette.plans.runs import apply_retention
from gazette.schemas import LEDGER, Settings
from gazette.sources import ledger as L
from gazette.sources.pages import page_listing, parse_page_batch


def rows(spark, specs):
    """Ledger rows from (ord, url, date, page_id)."""
    data = [(u, f"t{o}", None, None, d, None, "src", dt.datetime(2024, 1, 1), p, o) for o, u, d, p in specs]
    return spark.createDataFrame(data, LEDGER)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_legacy_files(spark):
    files = spark.createDataFrame(
        [('{"articles": [{"url": "a", "title": "t", "analysis": {"summary": "s", "tags": ["x"]}, "date": "2024-01-02T03:04:05", "notion_id": "n"}, {"url": "b"}]}',),
         ('["c", "d"]',), ('[{"url": "e", "source": "s"}]',), ("[]",), ("{}",), ('{"articles": [{"url"',), ("",), (None,)],
        "value string",
    )
    got = {r["url"]: r for r in L.upgrade_ledger(files).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e"]
    assert got["a"]["analysis"]["tags"] == ["x"] and got["a"]["published_date"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["a"]["ingest_ord"] < got["b"]["ingest_ord"]
    assert set(LEDGER.names) == set(got["a"].asDict())
    assert got["a"]["page_id"] == "n" and got["e"]["source"] == "s" and got["b"]["title"] is None


def test_strict_import_fails_on_corrupt_files(spark):
    bad = spark.createDataFrame([('{"articles": [{"url"',)], "value string")
    with pytest.raises(Exception, match="not valid JSON"):
        L.upgrade_ledger(bad, strict=True).collect()


def test_store_repeats_a_run_without_doubling(spark, tmp_path):
    store = L.LedgerStore(spark, str(tmp_path / "ledger"))
    assert store.read().count() == 0 and store.new_run() != store.new_run()
    store.append(rows(spark, [(0, "a", None, None)]), "r0")
    store.append(rows(spark, [(1, "b", None, None)]), "r1")
    store.append(rows(spark, [(1, "b", None, None)]), "r1")
    assert sorted(r["url"] for r in store.read().collect()) == ["a", "b"]
    assert [r["url"] for r in store.read(besides="r1").collect()] == ["a"]
    store.remove(store.read().where("url = 'a'"), "r1")
    store.append(rows(spark, [(2, "c", None, None)]), "r2")
    assert sorted(r["url"] for r in store.read().collect()) == ["b", "c"]
    assert sorted(r["url"] for r in store.read(besides="r1").collect()) == ["a", "c"]
    # a removed row's number is never given again
    assert spark.range(1).select(store.last_ord()).first()[0] == 2
    with pytest.raises(ValueError):
        store.append(rows(spark, []), "r/1")
    store.clear()
    assert store.read().count() == 0


SPECS = [(5, "a", day(3), "p1"), (1, "b", None, None), (2, "c", day(1), "p2"), (3, "d", day(1), ""), (4, "e", None, "p3"),
         (0, "f", day(9), "p4")]


def test_retention_order_and_gate(spark):
    ledger = rows(spark, SPECS)
    kept, removed = N.retain(ledger, 5, 4)
    assert {r["url"] for r in removed.collect()} == {"b", "e", "c", "d"}
    assert {r["url"] for r in kept.collect()} == {"a", "f"}
    kept, removed = N.retain(ledger, 6, 4)
    assert removed.count() == 0 and kept.count() == 6
    kept, removed = N.retain(ledger, 0, 100)
    assert removed.count() == 6 and kept.count() == 0
    kept, removed = N.retain(ledger, 0, 0)
    assert removed.count() == 0 and kept.count() == 6
    report = N.retention_report(ledger, 5, 4).first().asDict()
    assert report == {"size_before": 6, "removed": 4, "size_after": 2, "to_archive": 2}
    assert {r["page_id"] for r in N.archive_set(N.retain(ledger, 5, 4)[1]).collect()} == {"p2", "p3"}


def test_counting_plan_equals_sorting(spark, monkeypatch):
    rng = random.Random(3)
    dates = [None, day(1), day(1) + dt.timedelta(seconds=5), day(1) + dt.timedelta(seconds=5, microseconds=7), day(2), dt.datetime(1969, 12, 31, 12)]
    specs = [(i * 40_000, f"u{i}", rng.choice(dates), None) for i in range(120)]
    ledger = rows(spark, specs).cache()
    expected = [s[0] for s in sorted(specs, key=lambda s: (s[2] or dt.datetime.min, s[0]))]
    monkeypatch.setattr(N, "TOP_N_ROWS", -1)
    for n in (0, 1, 17, 60, 119, 120, 500):
        got = sorted(r["ingest_ord"] for r in N.oldest(ledger, n).collect())
        assert got == sorted(expected[:n]), n


def test_top_n_does_not_sort_everything(spark, plan_of):
    assert "TakeOrderedAndProject" in plan_of(N.oldest(rows(spark, SPECS), 2))


def test_removal_by_url(spark):
    ledger = rows(spark, [(0, "a", None, None), (1, "b", None, None), (2, None, None, None), (3, "a", None, None)])
    archived = spark.createDataFrame([("a",), ("",), (None,)], "url string")
    assert [r["ingest_ord"] for r in N.remove_by_url(ledger, archived).orderBy("ingest_ord").collect()] == [1, 2]


def test_listing_and_purge_report(spark):
    batch = (
        '{"results": [{"id": "1", "properties": {"URL": {"url": "a"}, "Title": {"title": [{"text": {"content": "T"}}]}}},'
        ' {"properties": {"URL": {"url": "b"}}}, {"id": "3", "properties": {"Title": {"title": []}}}, {"id": "4", "properties": {"URL": {"url": "d"}}}],'
        ' "has_more": true, "next_cursor": "x"}'
    )
    raw = spark.createDataFrame([(batch,), ('{"results": []}',)], "value string")
    listing = page_listing(raw.select(parse_page_batch(F.col("value")).alias("batch")))
    assert sorted((r["page_id"] or "-", r["url"] or "-", r["title"]) for r in listing.collect()) == [
        ("-", "b", "Sans titre"), ("1", "a", "T"), ("3", "-", "Sans titre"), ("4", "d", "Sans titre")]
    outcomes = listing.withColumn("status", F.when(F.col("page_id") == "4", 500).otherwise(200))
    ledger = rows(spark, [(0, "a", None, None), (1, "a", None, None), (2, "d", None, None)])
    logs = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-02",)], "log_date string")
    assert N.purge_report(outcomes, ledger, logs).first().asDict() == {
        "total_pages": 4, "archived_pages": 2, "archived_with_url": 1, "pages_without_id": 1, "errors": 2,
        "ledger_removed": 2, "logs_removed": 2}


def test_ledger_rows_leave_out_what_is_empty(spark):
    delivered = spark.createDataFrame(
        [("a", '«t»', "<p>x \"y\"</p>", '{"summary": "s"}', None, "", "f", 200, "n"),
         ("b", "", None, "oops", day(1), "i", "", 200, None), ("c", "t", "c", None, None, None, None, 500, "n"),
         ("d", "t", "c", None, None, None, None, None, None)],
        "link string, title string, content string, analysis string, published_date timestamp_ntz, image_url string, source string, status int, page_id string",
    )
    made = R.ledger_rows(delivered, dt.datetime(2024, 5, 6, 7, 8, 9))
    got = {r["url"]: r["j"] for r in made.select("url", R.sparse_json(made).alias("j")).collect()}
    assert got == {
        "a": '{"url":"a","title":"\'t\'","content":"x \'y\'","analysis":{"summary":"s"},"source":"f","processed_date":"2024-05-06T07:08:09","notion_id":"n"}',
        "b": '{"url":"b","analysis":{},"date":"2024-01-02T00:00:00","image_url":"i","processed_date":"2024-05-06T07:08:09"}',
    }


def test_page_record(spark):
    articles = spark.createDataFrame(
        [("https://h/1", "l&#039;air", "a &amp; b", '```json\n{"isCommercial": true, "significanceScore": 3, "summary": "s", "tags": ["A", "B"], "isDouble": true}```',
          "https://h/i.jpg", day(1), "Feed"),
         ("ftp://x", None, None, "pas du JSON", "i.jpg", None, "")],
        "link string, title string, content string, analysis string, image_url string, published_date timestamp_ntz, source string",
    )
    got = {r["link"]: r["record"].asDict(True) for r in R.page_record(articles, parent="db").collect()}
    first, second = got["https://h/1"]["properties"], got["ftp://x"]["properties"]
    assert first["Title"]["title"] == [{"text": {"content": "l'air"}}]
    assert first["Contenu"]["rich_text"] == [{"text": {"content": "a & b"}}]
    assert first["URL"] == {"type": "url", "url": "https://h/1"} and first["Date"]["date"] == {"start": "2024-01-02T00:00:00"}
    assert first["Tags"]["multi_select"] == [{"name": "A"}, {"name": "B"}] and first["Flux"]["multi_select"] == [{"name": "Feed"}]
    assert (first["Commercial"]["checkbox"], first["Score"]["number"], first["Double"]["checkbox"]) == (True, 3.0, True)
    assert first["Image"]["files"] == [{"name": "image", "type": "external", "external": {"url": "https://h/i.jpg"}}]
    assert got["https://h/1"]["cover"]["external"]["url"] == "https://h/i.jpg" and got["https://h/1"]["parent"]["database_id"] == "db"
    assert second["URL"]["url"] is None and second["Image"] is None and got["ftp://x"]["cover"] is None
    assert second["Résumé"]["rich_text"] == [{"text": {"content": "pas du JSON"}}]
    assert second["Flux"]["multi_select"] == [] and second["Date"]["date"] is None and second["Contenu"]["rich_text"] == []
    assert second["Score"]["number"] == 0.0


def test_imports_are_numbered_after_what_the_store_holds(spark, tmp_path):
    store = L.LedgerStore(spark, str(tmp_path / "ledger"))
    for urls in ('["a", "b"]', '["c", "d"]'):
        store.take_over(L.upgrade_ledger(spark.createDataFrame([(urls,)], "value string")))
    held = {r["url"]: r["ingest_ord"] for r in store.read().collect()}
    assert sorted(held, key=held.get) == ["a", "b", "c", "d"] and len(set(held.values())) == 4
    kept, removed = N.retain(store.read(), 1, 1)
    assert [r["url"] for r in removed.collect()] == ["a"] and kept.count() == 3


def test_store_keeps_the_pages_to_archive(spark, tmp_path):
    store = L.LedgerStore(spark, str(tmp_path / "ledger"))
    assert store.to_archive().count() == 0
    store.append(rows(spark, [(0, "a", day(1), "p1"), (1, "b", day(2), None), (2, "c", day(3), "p3")]), "r0")
    archive = apply_retention(store.read(), store, "r1", Settings(auto_clean_threshold=2, clean_remove_count=2))
    assert [r["page_id"] for r in archive.collect()] == ["p1"]
    assert [(r["page_id"], r["run"]) for r in store.to_archive().collect()] == [("p1", "r1")]
    # what is removed is written, not what stays
    assert spark.read.parquet(f"{store.path}/removed/run=r1").count() == 2
    assert [r["url"] for r in store.read().collect()] == ["c"]
