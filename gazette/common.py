"""Shared helpers: the shared work folder, staged tables and a join that survives hot keys."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are never more
#: than HOT_SHARE hot keys and the table of them is always small enough to broadcast.
HOT_SHARE = 100_000
#: Below this many rows a key is never worth splitting.
HOT_ROWS = 200_000


#: Folder of each local session that runs without ``spark.checkpoint.dir``.
_LOCAL_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: on a cluster a
    machine-local folder would not be visible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="gazette-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Staged:
    """A table written to the shared folder and its exact number of rows."""

    df: DataFrame
    rows: int
    path: str | None = None


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a table that is staged or written within go when it is there, not at some later garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: Staged) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        spark = table.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, rows: Column | None = None) -> Staged:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, lets several consumers
    read only the columns they need, and gives the planner exact sizes. The row count
    (or ``rows``, when rows are to be exploded later) is taken during the write.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    seen = Observation()
    counted = F.count(F.lit(1)) if rows is None else rows
    df.observe(seen, counted.alias("rows")).write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), seen.get["rows"] or 0, path)


def skew_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str | list[str],
    rows: int | None = None,
    load: DataFrame | None = None,
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join on ``key`` where a single key may hold a large part of ``facts``.

    ``rows`` bounds the rows of ``facts`` where that is known: up to ``hot_rows`` no key
    can be heavy and a plain join does. Otherwise rows per key are counted with map-side
    combine (or given as ``load``: key, rows), the rows of a hot key are spread over
    salts by the hash of ``spread`` (a column or several), and the matching rows of ``dim`` are repeated
    once per salt; every other key stays at salt 0. Rows without a key match nothing and
    are spread likewise. ``how`` is inner or left.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if rows is not None and rows <= hot_rows:
        return facts.join(dim, key, how)
    if load is None:
        load = facts.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    if rows is None:
        total = F.coalesce(load.agg(F.sum("rows")).scalar(), F.lit(0))
        per_salt = F.greatest(F.lit(float(hot_rows)), total / float(HOT_SHARE))
    else:
        per_salt = F.lit(float(max(hot_rows, rows // HOT_SHARE)))
    hot = load.where(F.col(key).isNotNull()).withColumn("_copies", F.ceil(F.col("rows") / per_salt)).where("_copies > 1")
    # at most HOT_SHARE keys can hold more than per_salt rows, so this broadcast is bounded
    hot = F.broadcast(hot.select(key, "_copies"))
    by = F.xxhash64(*([spread] if isinstance(spread, str) else spread))
    copies = F.when(F.col(key).isNull(), HOT_SHARE).otherwise(F.col("_copies"))
    salt = F.coalesce(F.pmod(by, copies), F.lit(0)).cast("int")
    salts = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)).cast("int") - 1)
    salted = facts.join(hot, key, "left").withColumn("_salt", salt).drop("_copies")
    repeated = dim.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_copies")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(values: dict[str, str]) -> Column:
    """A string map as one constant, so a large table is not planned entry by entry."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone."""
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(c)) * 60 + F.minute(c)
    seconds = F.extract(F.lit("SECOND"), c).cast("decimal(20,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def blank_to_null(c: Column) -> Column:
    """Empty string counts as missing."""
    return F.nullif(c, F.lit(""))
