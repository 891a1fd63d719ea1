import datetime as dt

import pytest
from pyspark.sql import functions as F

from gazette.common import new_folder
from gazette.operators.logs import read_log
from gazette.plans import runs
from gazette.schemas import FEED_DOCUMENT, Settings
from gazette.sources import feeds
from gazette.sources.ledger import LedgerStore
from gazette.streaming import intake as T

RUN = dt.datetime(2024, 6, 1)
KIND = "feed_url string, link string, fetched_at timestamp, published_date timestamp_ntz"


def arrival(feed, link, minute):
    at = dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)
    return (feed, link, at, at)


@pytest.fixture
def landing(spark, tmp_path):
    """A folder to land batches in, and the stream over it, one file per micro-batch."""
    path = str(tmp_path / "landing")

    def land(rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)

    return land, stream


def test_links_arrive_once(spark, landing):
    land, stream = landing
    land([arrival("f", "a", 0), arrival("g", "a", 1), arrival("f", "b", 2)])
    land([arrival("f", "a", 3), arrival("f", "c", 4)])
    land([arrival("h", "a", -5_000)])  # far too late for any watermark, and the first
    out = T.rolled_up(stream(), T.first_arrivals(), spark, "dedup")
    assert sorted((r["link"], r["feed_url"]) for r in out.collect()) == [("a", "h"), ("b", "f"), ("c", "f")]


def test_counts_and_snapshots_equal_the_batch_form(spark, landing):
    land, stream = landing
    rows = [arrival(f"f{i % 3}", f"l{i}", i * 2) for i in range(100)]
    land(rows[:60])
    land(rows[60:])
    land([arrival("f1", "late", -10_000), arrival("f1", "later", 3)])
    batch = spark.createDataFrame([*rows, arrival("f1", "late", -10_000), arrival("f1", "later", 3)], KIND)

    counts = T.rolled_up(stream(), T.feed_window_counts(), spark, "counts")
    expected = batch.groupBy(F.window("fetched_at", "10 minutes").alias("w"), "feed_url").count()
    expected = expected.select("w.start", "feed_url", "count")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, expected.collect()))
    assert counts.agg(F.sum("arrivals")).first()[0] == 102

    first = T.rolled_up(stream(), T.first_snapshots(), spark, "snapshots")
    expected = batch.groupBy(F.window("fetched_at", "5 minutes").alias("w"), "feed_url").agg(
        F.min(F.struct("fetched_at", "link")).alias("f"), F.count(F.lit(1)))
    expected = expected.select("w.start", "feed_url", "f.fetched_at", "f.link", "count(1)")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, expected.collect()))


def test_rollups_go_on_from_their_checkpoint(spark, landing):
    land, stream = landing
    path, state, rollup = new_folder(spark, "rollup"), new_folder(spark, "state"), T.feed_window_counts()
    total = lambda: rollup.read(spark, path, "window_start timestamp, feed_url string, arrivals long").agg(F.sum("arrivals")).first()[0]
    land([arrival("f", "a", 0), arrival("f", "b", 1)])
    T.roll_up(stream(), rollup, path, state, available_now=True).awaitTermination()
    assert total() == 2
    land([arrival("f", "c", 2)])
    T.roll_up(stream(), rollup, path, state, available_now=True).awaitTermination()
    T.roll_up(stream(), rollup, path, state, available_now=True).awaitTermination()
    assert total() == 3


def run(stream, store, state, settings=Settings()):
    T.intake_stream(stream, store, state, RUN, settings, available_now=True).awaitTermination()


def test_intake_meets_the_ledger_across_runs(spark, landing):
    land, stream = landing
    store, state = LedgerStore(spark, new_folder(spark, "ledger")), new_folder(spark, "state")
    land([arrival("f", "a", 0), arrival("f", "b", 1)])
    run(stream(), store, state)
    # far later, so the watermark has forgotten link a: only the ledger knows it
    land([arrival("f", "a", 10_000), arrival("f", "c", 10_001)])
    land([arrival("f", "a", 20_000), arrival("f", "d", 20_001)])
    run(stream(), store, state)
    ledger = store.read()
    assert sorted(r["url"] for r in ledger.collect()) == ["a", "b", "c", "d"]
    assert ledger.select("ingest_ord").distinct().count() == 4


def test_repeated_batch_changes_nothing(spark):
    store = LedgerStore(spark, new_folder(spark, "ledger"))
    handle = T.ledger_batches(store, Settings(auto_clean_threshold=3, clean_remove_count=2), RUN)
    batches = [[arrival("f", f"l{b}{i}", b * 10 + i) for i in range(2)] for b in range(4)]
    for number, rows in enumerate(batches):
        handle(spark.createDataFrame(rows, KIND), number)
    before = sorted(map(tuple, store.read().select("url", "published_date").collect()))
    handle(spark.createDataFrame(batches[3], KIND), 3)
    assert sorted(map(tuple, store.read().select("url", "published_date").collect())) == before
    # 2, 4 -> 2, 4 -> 2, 4 -> 2: the oldest two go each time
    assert [u for u, _ in before] == ["l30", "l31"]


def test_retention_equals_the_batch_form(spark, landing):
    land, stream = landing
    rows = [arrival("f", f"l{i:02d}", 50 - i) for i in range(20)]
    land(rows)
    store = LedgerStore(spark, new_folder(spark, "ledger"))
    run(stream(), store, new_folder(spark, "state"), Settings(auto_clean_threshold=10, clean_remove_count=5))
    assert sorted(r["url"] for r in store.read().collect()) == [f"l{i:02d}" for i in range(15)]


def test_a_new_checkpoint_on_a_used_store_loses_nothing(spark, landing):
    land, stream = landing
    store = LedgerStore(spark, new_folder(spark, "ledger"))
    land([arrival("f", "a", 0)])
    run(stream(), store, new_folder(spark, "state"))
    land([arrival("f", "b", 1)])
    run(stream(), store, new_folder(spark, "state"))
    assert sorted(r["url"] for r in store.read().collect()) == ["a", "b"]
    assert spark.read.parquet(f"{store.path}/rows").select("run").distinct().count() == 2


def test_late_and_repeated_links_reach_the_ledger_once(spark, landing):
    land, stream = landing
    store, state = LedgerStore(spark, new_folder(spark, "ledger")), new_folder(spark, "state")
    land([arrival("f", "a", 20_000), arrival("g", "a", 19_999), arrival("f", None, 1)])
    run(stream(), store, state)
    land([arrival("f", "late", 0), arrival("f", "a", 20_001)])
    run(stream(), store, state)
    assert sorted((r["url"], r["source"]) for r in store.read().collect()) == [("a", "g"), ("late", "f")]


def test_pages_of_a_trimmed_stream_can_be_archived(spark):
    store = LedgerStore(spark, new_folder(spark, "ledger"))
    handle = T.ledger_batches(store, Settings(auto_clean_threshold=3, clean_remove_count=2), None)
    handle(spark.createDataFrame([arrival("f", f"l{i}", i) for i in range(4)], KIND), 0)
    assert sorted(r["url"] for r in store.to_archive().collect()) == ["l0", "l1"]
    assert store.read().where("processed_at is null").count() == 0


FEEDS = [("u1", "Un"), ("u2", "Deux")]


def feed(url, minute, items):
    body = "".join(
        f"<item><title>{t}</title><link>{l}</link><description>{d}</description><pubDate>{day}</pubDate></item>" for t, l, d, day in items
    )
    return (url, dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute), f"<rss><channel>{body}</channel></rss>")


ONE = ("Le grand test de la console", "l1", "promo 20 €", "2024-01-01")
# the second poll repeats a link, and its second feed was fetched before the first poll
POLLS = [
    [feed("u1", 10, [ONE, ("Autre sujet", "l2", "deux", "2024-01-02")]), ("u2", None, "<rss><cut")],
    [feed("u1", 20, [ONE, ("Un grand test de la console", "l3", "trois", "2024-01-03")]), feed("u2", 3, [("Neuf", "late", "quatre", "2024-01-04")])],
]


def test_article_stream_equals_runs_over_the_same_feeds(spark, tmp_path):
    registry = feeds.feed_registry(spark, FEEDS)
    pages = lambda: spark.createDataFrame([("l2", "<article>Texte de la page</article>"), ("l9", None)], "url string, html string")
    settings = Settings(max_articles_per_feed=2, auto_clean_threshold=3, clean_remove_count=1, log_interactions=True)
    landing, state = str(tmp_path / "feeds"), new_folder(spark, "state")
    streamed, direct = (LedgerStore(spark, new_folder(spark, "ledger")) for _ in range(2))
    logs, records = new_folder(spark, "logs"), new_folder(spark, "records")
    steps = runs.Steps(log_path=logs, parent="db")
    for poll in POLLS:
        documents = spark.createDataFrame(poll, FEED_DOCUMENT).coalesce(1)
        documents.write.mode("append").parquet(landing)
        runs.run_intake(spark, feeds.rss_entries(documents), registry, pages(), direct, RUN, settings)
        stream = feeds.stream_feed_documents(spark, landing)
        T.article_stream(stream, registry, pages, streamed, records, state, RUN, settings, steps, available_now=True).awaitTermination()
    shown = lambda store: sorted(map(tuple, store.read().select("url", "title", "content", "analysis", "source", "page_id").collect()))
    # the fourth row exceeds the threshold: the oldest goes
    assert [r[0] for r in shown(streamed)] == ["l2", "l3", "late"]
    assert shown(streamed) == shown(direct)
    held = {r["url"]: r for r in streamed.read().collect()}
    assert held["l2"]["content"] == "Texte de la page" and held["l3"]["analysis"]["isDouble"]
    written = spark.read.parquet(records).select("link", "record.parent.database_id")
    assert sorted(map(tuple, written.collect())) == [(x, "db") for x in ("l1", "l2", "l3", "late")]
    logged = {r["link"]: r for r in read_log(spark, logs).collect()}
    assert sorted(logged) == ["l1", "l2", "l3", "late"]
    # a prompt lists the titles of the ledger as it stood, and the answer is the scorer's
    assert all(f". {t}" in logged["l3"]["prompt"] for t in ("Le grand test de la console", "Autre sujet")) and "isDouble" in logged["l3"]["response"]
    assert "précédents" not in logged["l1"]["prompt"]


def test_a_repeated_article_batch_changes_nothing(spark):
    registry = feeds.feed_registry(spark, FEEDS)
    pages = lambda: spark.createDataFrame([], "url string, html string")
    store, records = LedgerStore(spark, new_folder(spark, "ledger")), new_folder(spark, "records")
    settings = Settings(max_articles_per_feed=2, auto_clean_threshold=2, clean_remove_count=1)
    handle = T.article_batches(registry, pages, store, records, RUN, settings)
    state = lambda: (
        sorted(r["url"] for r in store.read().collect()), sorted(r["page_id"] for r in store.to_archive().collect()),
        sorted(r["link"] for r in spark.read.parquet(records).collect()),
    )
    handle(spark.createDataFrame(POLLS[0] + POLLS[1][1:], FEED_DOCUMENT), 0)
    before = state()
    assert before[0] == ["l2", "late"] and len(before[1]) == 1 and before[2] == ["l1", "l2", "late"]
    handle(spark.createDataFrame(POLLS[0] + POLLS[1][1:], FEED_DOCUMENT), 0)
    assert state() == before
    # a batch whose links are all known adds nothing
    handle(spark.createDataFrame(POLLS[1][1:], FEED_DOCUMENT), 1)
    assert state() == before
