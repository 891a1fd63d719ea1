"""Streams over landed feed documents and arriving links."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from gazette.common import new_folder, stage
from gazette.operators import selection as S
from gazette.plans import runs
from gazette.schemas import Settings
from gazette.sources.feeds import rss_entries
from gazette.sources.ledger import LedgerStore

#: The polling interval and the feed cache time.
POLL_INTERVAL = "10 minutes"
FEED_CACHE = "5 minutes"


@dataclass(frozen=True)
class Rollup:
    """An aggregate of a stream, kept as one partial result per micro-batch and united when it is read.

    Nothing waits for a watermark, so a late row corrects its window however late it is and the windows still open
    count as they stand; there is no state that could grow. ``start`` makes the keys and partial values of
    arrivals, ``unite`` those of several partial values.
    """

    keys: tuple[str, ...]
    start: Callable[[DataFrame], DataFrame]
    unite: dict[str, Callable[[str], Column]]
    shown: Callable[[DataFrame], DataFrame]

    def partial(self, arrivals: DataFrame) -> DataFrame:
        return self._united(self.start(arrivals))

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        """The result so far; ``schema`` is that of the partial values."""
        return self.shown(self._united(spark.read.schema(schema).parquet(path)))

    def _united(self, values: DataFrame) -> DataFrame:
        return values.groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.unite.items()])


def first_arrivals() -> Rollup:
    """Each link once, as it arrived first. Arrivals have link, feed_url and fetched_at (TIMESTAMP)."""
    first = F.struct("fetched_at", "feed_url").alias("first")
    return Rollup(("link",), lambda a: a.select("link", first), {"first": F.min}, lambda r: r.select("link", "first.fetched_at", "first.feed_url"))


def feed_window_counts(width: str = POLL_INTERVAL) -> Rollup:
    """Arrivals per feed and polling interval."""
    return Rollup(
        ("window_start", "feed_url"),
        lambda a: a.select(F.window("fetched_at", width)["start"].alias("window_start"), "feed_url", F.lit(1).cast("long").alias("arrivals")),
        {"arrivals": F.sum},
        lambda r: r,
    )


def first_snapshots(ttl: str = FEED_CACHE) -> Rollup:
    """The first snapshot of every feed in each cache interval and how many there were; the rest would
    be served from the cache."""
    return Rollup(
        ("window_start", "feed_url"),
        lambda a: a.select(
            F.window("fetched_at", ttl)["start"].alias("window_start"), "feed_url",
            F.struct("fetched_at", "link").alias("first"), F.lit(1).cast("long").alias("snapshots"),
        ),
        {"first": F.min, "snapshots": F.sum},
        lambda r: r.select("window_start", "feed_url", "first.fetched_at", "first.link", "snapshots"),
    )


def roll_up(arrivals: DataFrame, rollup: Rollup, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start writing the partial results of a stream below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup.partial(batch).write.mode("overwrite").parquet(f"{path}/run={_run(batch, batch_id)}")

    return _started(arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), available_now)


def rolled_up(arrivals: DataFrame, rollup: Rollup, spark: SparkSession, label: str) -> DataFrame:
    """Run a stream over what is available and return its rolled up result."""
    path = new_folder(spark, label)
    roll_up(arrivals, rollup, path, new_folder(spark, f"{label}-state"), available_now=True).awaitTermination()
    empty = spark.createDataFrame([], arrivals.schema)
    return rollup.read(spark, path, rollup.partial(empty).schema)


def _run(batch: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch: the same when it is repeated, and no other stream's."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{stream}-{batch_id}"


def _started(writer: DataStreamWriter, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL_INTERVAL)).start()


def ledger_batches(store: LedgerStore, settings: Settings, run_ts: datetime.datetime | None):
    """``foreachBatch`` function: append links the ledger does not know, then retain.

    A link counts once per batch, by its first arrival, and rows without one are left out.
    Without ``run_ts`` every batch stamps its own time. A repeated batch overwrites its own
    output and no other run's.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = _run(batch, batch_id)
        before = store.read(besides=run)
        batch = batch.where("link IS NOT NULL")
        first = [c for c in ("fetched_at", "ingest_ord") if c in batch.columns] or ["link"]
        unknown = S.new_articles(S.dedup_batch(batch, tuple(first)), before)
        top = store.last_ord(run)
        null = F.lit(None)
        rows = unknown.select(
            F.col("link").alias("url"),
            *[
                F.col(c).alias(c) if c in batch.columns else null.cast(t).alias(c)
                for c, t in (
                    ("title", "string"), ("content", "string"),
                )
            ],
            null.cast(before.schema["analysis"].dataType).alias("analysis"),
            F.col("published_date"),
            null.cast("string").alias("image_url"),
            F.col("feed_url").alias("source"),
            F.coalesce(F.lit(run_ts), F.localtimestamp()).cast("timestamp_ntz").alias("processed_at"),
            F.md5("link").alias("page_id"),
            (top + 1 + (F.col("ingest_ord") if "ingest_ord" in batch.columns
                        else F.monotonically_increasing_id())).alias("ingest_ord"),
        )
        rows = stage(rows, "arrived")
        store.append(rows.df, run)
        if rows.rows:  # a batch that adds nothing removes nothing
            runs.apply_retention(before.unionByName(rows.df.select(*before.columns)), store, run, settings)

    return handle


def intake_stream(
    arrivals: DataFrame,
    store: LedgerStore,
    checkpoint: str,
    run_ts: datetime.datetime | None = None,
    settings: Settings = Settings(),
    available_now: bool = False,
) -> StreamingQuery:
    """Start the intake of links: new ones into the ledger every polling interval.

    Only the ledger decides what is new, so a link that arrives late, as in a backfill, is
    taken however old it is.
    """
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint)
    return _started(writer.foreachBatch(ledger_batches(store, settings, run_ts)), available_now)


def article_batches(
    registry: DataFrame,
    read_pages: Callable[[], DataFrame],
    store: LedgerStore,
    records_path: str,
    run_ts: datetime.datetime | None = None,
    settings: Settings = Settings(),
    steps: runs.Steps = runs.Steps(),
):
    """``foreachBatch`` function over landed feed documents: a whole intake run per batch.

    Entries are parsed, limited per feed, met with the ledger, given the pages landed by then, scored, recorded below
    ``records_path``, appended and retained, all under the batch's one name, so a repeated batch overwrites what it wrote in
    each of these tables. Without ``run_ts`` every batch stamps its own time.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = _run(batch, batch_id)
        at = run_ts or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        records = runs.run_intake(
            store.spark, rss_entries(batch), registry, read_pages(), store, at, settings, run, steps
        )
        records.write.mode("overwrite").parquet(f"{records_path}/run={run}")

    return handle


def article_stream(
    documents: DataFrame,
    registry: DataFrame,
    read_pages: Callable[[], DataFrame],
    store: LedgerStore,
    records_path: str,
    checkpoint: str,
    run_ts: datetime.datetime | None = None,
    settings: Settings = Settings(),
    steps: runs.Steps = runs.Steps(),
    available_now: bool = False,
) -> StreamingQuery:
    """Start the intake of articles from a stream of feed documents (``sources.feeds.stream_feed_documents``)."""
    writer = documents.writeStream.option("checkpointLocation", checkpoint)
    return _started(
        writer.foreachBatch(article_batches(registry, read_pages, store, records_path, run_ts, settings, steps)), available_now
    )
