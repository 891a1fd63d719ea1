import pytest
from pyspark.sql import functions as F

from gazette.operators import selection as S
from gazette.schemas import Settings


@pytest.fixture
def entries(spark):
    rows = [("f1", i, f"l{i}", 0) for i in range(6)] + [("f2", 0, "l0", 1), ("f2", 1, "m1", 1), ("f3", 0, "n", 2)]
    return spark.createDataFrame(rows, "feed_url string, pos int, link string, feed_ord int")


def test_first_k_in_document_order(entries):
    kept = S.first_k_per_feed(entries.orderBy(F.desc("pos")), 2)
    assert sorted((r["feed_url"], r["pos"]) for r in kept.collect()) == [
        ("f1", 0), ("f1", 1), ("f2", 0), ("f2", 1), ("f3", 0)]
    assert S.first_k_per_feed(entries, 0).count() == 0
    with pytest.raises(ValueError):
        S.first_k_per_feed(entries, -1)


def test_first_k_is_limited_before_the_shuffle(entries, plan_of):
    plan = plan_of(S.first_k_per_feed(entries, 2))
    assert plan.count("WindowGroupLimit") == 2


def test_dedup_keeps_the_first_feed(entries, plan_of):
    deduped = S.dedup_batch(entries)
    assert [r["feed_url"] for r in deduped.where("link = 'l0'").collect()] == ["f1"]
    assert deduped.count() == 8
    assert "WindowGroupLimit" in plan_of(deduped)


def test_ledger_filters(spark, entries, plan_of):
    ledger = spark.createDataFrame([("l1",), ("n",), (None,)], "url string")
    fresh = S.new_articles(entries, ledger)
    assert {r["link"] for r in fresh.collect()} == {"l0", "l2", "l3", "l4", "l5", "m1"}
    assert "LeftAnti" in plan_of(fresh)
    assert {r["link"] for r in S.already_processed(entries, ledger).collect()} == {"l1", "n"}


def test_counts_include_empty_feeds(spark, entries):
    registry = spark.createDataFrame([(0, "f1", "A"), (1, "f9", "B")], "feed_ord int, feed_url string, feed_name string")
    got = {r["feed_url"]: (r["found"], r["after_limit"], r["is_empty"]) for r in S.feed_counts(entries, registry, 3).collect()}
    assert got == {"f1": (6, 3, False), "f9": (0, 0, True)}


def test_settings():
    assert Settings.from_mapping({"MAX_ARTICLES_PER_FEED": "5 # five", "AUTO_CLEAN_THRESHOLD": "x"}) == Settings(
        max_articles_per_feed=5)
    assert Settings.from_mapping({"ENABLE_CHATGPT_LOGS": "True"}).log_interactions
    with pytest.raises(ValueError):
        Settings(max_articles_per_feed=-1)


def test_first_k_takes_the_newest_snapshot(spark):
    rows = [("f", "2024-01-01", 0, "o0"), ("f", "2024-01-01", 1, "o1"), ("f", "2024-01-02", 0, "n0"), ("g", "2024-01-01", 0, "g0")]
    entries = spark.createDataFrame(rows, "feed_url string, fetched_at string, pos int, link string")
    assert sorted(r["link"] for r in S.first_k_per_feed(entries, 3).collect()) == ["g0", "n0"]
