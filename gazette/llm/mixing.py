"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and queued epoch after epoch. A document's
virtual finish time is the number of words its source has sent when the document is through,
divided by the source's target. All documents of all epochs are put in order of that time
and the mix takes them until its budget is used up. Running sums are split: words per range
of the shuffle hash first, then inside each range, so no task holds a whole source.

Defined results: null text has size 0; null is a source of its own, last in order; an empty
table gives an empty mix; documents without words are never taken; rows that agree in id and
text are ordered among themselves arbitrarily, which gives the same set of rows; the
sum taken differs from the budget by less than one document. Other columns are carried along
by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.tables import BLANKS, keep, table

WEIGHTS = (5, 2, 1)
#: The mix holds SHARE / 100 of all words; a source is repeated at most EPOCHS times.
SHARE = 150
EPOCHS = 2
#: Hexadecimal digits of the hash ranges over which running sums are split.
DIGITS = 4


def sized(docs: DataFrame) -> DataFrame:
    """Number of words and shuffle key of each document."""
    text = F.coalesce("text", F.lit(""))
    # one character per word, the rest dropped
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), BLANKS, "")
    return docs.select(
        "doc_id", "source", F.char_length(marks).cast("long").alias("size"), F.md5(text).alias("_text")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Target of each source: weighted shares, stopped at ``epochs`` times the source and reshared.

    Sources reach their stop in the order of stop by weight, so one running sum in that
    order finds who is stopped. One row per source throughout.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    sources = sources.withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))))
    stop = epochs * F.col("source_size")
    order = Window.orderBy(stop / F.col("_w"), F.asc_nulls_last("source"))
    every = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = sources.withColumn("_budget", F.sum("source_size").over(every) * share / 100)
    rest = rest.withColumn("_left", F.col("_budget") - F.coalesce(F.sum(stop).over(before), F.lit(0)))
    rest = rest.withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    rest = rest.withColumn("_unit", F.col("_left") / F.col("_weights"))
    # the unit share of the first source in the order that is not stopped holds for all after it
    unit = F.min(F.when(stop > F.col("_unit") * F.col("_w"), F.struct((stop / F.col("_w")).alias("o"), F.col("source").isNull().alias("l"), F.col("source").alias("s"), F.col("_unit").alias("u")))).over(every)["u"]
    target = F.least(stop.cast("double"), F.coalesce(unit * F.col("_w"), stop.cast("double")))
    return rest.select(F.col("source").alias("_source"), "source_size", target.alias("target"), "_budget")


def _running(rows: DataFrame, keys: list[str], range_: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` along ``order`` within ``keys``, taken per ``range_`` and joined."""
    parts = rows.groupBy(*keys, range_).agg(F.sum(value).alias("_part"))
    ahead = Window.partitionBy(*keys or [F.lit(0)]).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_part").over(ahead), F.lit(0))).drop("_part")
    inside = Window.partitionBy(*keys, range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = rows[range_] == parts[range_]
    for k in keys:
        on = on & rows[k].eqNullSafe(parts[k])
    joined = rows.withColumn("_in", F.sum(value).over(inside)).alias("r").join(parts.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*keys, range_]])
    return joined.select("r.*", (F.col("_in") + F.col("_ahead")).alias(name)).drop("_in")


def queued(sizes: DataFrame, goals: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Rows ``doc_id, source, size, _text`` with source_size, target and times taken."""
    rows = sizes.join(goals, sizes["source"].eqNullSafe(goals["_source"]), "left").drop("_source")
    turns = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.md5(F.concat_ws(":", F.col("_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text"))
    turns = turns.withColumn("_key", key)
    turns = turns.withColumn("_range", F.concat_ws("", F.col("_epoch").cast("string"), F.substring("_key", 1, DIGITS)))
    shuffled = [F.col("_key"), F.col("doc_id"), F.col("size")]
    sent = _running(turns, ["source"], "_range", shuffled, "size", "_sent")
    timed = sent.withColumn("_time", F.when(F.col("target") > 0, F.col("_sent") / F.col("target")).otherwise(0.0))
    timed = timed.withColumn("_slot", F.floor(F.col("_time") * 16**DIGITS))
    out = _running(timed, [], "_slot", [F.col("_time"), *shuffled], "size", "_out")
    return out.withColumn("_taken", (F.col("_out") <= F.col("_budget")) & (F.col("target") > 0) & (F.col("size") > 0))


def _counted(docs: DataFrame) -> DataFrame:
    """One row per document (id, source, size, text hash) with the number of epochs in which it is taken."""
    sizes = keep(sized(docs), "sizes")
    taken = queued(sizes, targets(sizes))
    # equal rows are one group and share what their copies took
    same = ["doc_id", "source", "size", "_text"]
    grouped = taken.groupBy(*same).agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.count(F.lit(1)).alias("_turns"), F.count_if("_taken").alias("_times"),
    )
    copies = (F.col("_turns") / EPOCHS).cast("int")
    each = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.floor(F.col("_times") / copies).cast("int") + (i < F.col("_times") % copies).cast("int"))
    return grouped.select(*same, "source_size", "target", copies.alias("_copies"), F.posexplode(each).alias("_copy", "_times"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each taken document with its own columns, as often as it is taken."""
    times = _counted(docs.select("doc_id", "source", "text")).where("_times > 0")
    times = keep(times.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_text", "_copies", "_times"), "mix")
    rows = docs.select(F.struct("*").alias("_row"))
    id_, source, text = F.col("_row.doc_id"), F.col("_row.source"), F.md5(F.coalesce(F.col("_row.text"), F.lit("")))
    rows = rows.withColumn("_k", F.xxhash64(id_, source, text))
    times = times.groupBy("_id", "_source", "_text").agg(F.sum("_times").alias("_sum"), F.max("_copies").alias("_n"))
    times = times.withColumn("_k2", F.xxhash64("_id", "_source", "_text"))
    found = rows.join(times, (rows["_k"] == times["_k2"]) & id_.eqNullSafe(times["_id"]) & source.eqNullSafe(times["_source"]) & (text == times["_text"]))
    # documents with an equal twin share the times of all twins evenly, first rows first
    twins = Window.partitionBy("_k", "_id", "_source", "_text").orderBy(F.monotonically_increasing_id())
    alone, several = found.where("_n = 1"), found.where("_n > 1")
    n = F.col("_n")
    several = several.withColumn("_at", F.row_number().over(twins) - 1).withColumn("_sum", F.floor(F.col("_sum") / n) + (F.col("_at") < F.col("_sum") % n).cast("long")).drop("_at")
    every = alone.unionByName(several).where("_sum > 0")
    return every.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int")))).select("_row.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words the mix takes of it."""
    rows = _counted(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"))


def _sql() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS t,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () * {SHARE} / 100.0 AS budget,
        coalesce(sum({EPOCHS} * source_size) OVER o, 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ws FROM s
        WINDOW o AS (ORDER BY {EPOCHS} * source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (budget::DOUBLE - stopped::DOUBLE) / ws::DOUBLE AS unit FROM r),
g AS (SELECT source, source_size, budget::DOUBLE AS budget, least({EPOCHS} * source_size::DOUBLE, coalesce(w * (SELECT unit FROM u
        WHERE {EPOCHS} * source_size > unit * w ORDER BY {EPOCHS} * source_size::DOUBLE / w, source NULLS LAST LIMIT 1), {EPOCHS} * source_size::DOUBLE)) AS target FROM u),
q AS (SELECT d.*, source_size, target, budget, e, md5(e || ':' || coalesce(doc_id::VARCHAR, '') || ':' || t) AS k
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range({EPOCHS}) x(e)),
v AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY e, k, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE / target AS vt FROM q WHERE target > 0),
z AS (SELECT *, sum(size) OVER (ORDER BY vt, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS o FROM v)
SELECT doc_id, d.size, g.source_size, g.target, coalesce(n, 0)::BIGINT AS taken FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN (SELECT doc_id, sum(size) AS n FROM z WHERE o <= budget GROUP BY doc_id) USING (doc_id)"""


SQL = _sql()
