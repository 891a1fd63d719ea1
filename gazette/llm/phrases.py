"""Phrases whose words occur together more often than their parts would by chance.

Level-wise mining. The words of all documents are kept once, as a list of numbers for each document: 64-bit hashes of
language and word, under a seed for which no two words of the table share one, so that runs of numbers are runs of words.
Runs of one length are counted where both the run without its last word and the one without its first are frequent. Which
may be is asked of a bitmap with a bit for each frequent run's hash, broadcast in at most BROADCAST bytes however many there
are: what it lets through in error is counted and found rare. Where many are met, most of them rare, hashes of few bits are
counted before runs, and runs only where those are frequent. Nothing else of the occurrences is written, and counts are
combined before they are shuffled. Shuffle files go when the step that wrote them ends.

A list has a gap wherever a piece ends, so phrases never cross
pieces. A phrase knows how often each of its beginnings and ends occurs, from the phrases it is made
of; all products are decimals of 38 digits. A phrase within a longer one that is as frequent is also
within one that is a single word longer and as frequent, so only those are looked at.

Defined results: null text is empty; null lang is "und"; rows with equal or null ids are separate documents;
ties are ranked by count, then by phrase in UTF-8 byte order; languages without a candidate, and an empty
table, give no rows; columns other than text and lang are not looked at.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.common import Staged, shuffles_dropped, skew_join, stage
from gazette.llm.tables import keep, table

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text whose words a task takes, and the most parts they are dealt to.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 65536
#: Bytes of a bitmap that is broadcast, and those that 64 bits of it take there.
BROADCAST = 24 << 20
WORD_BYTES = 40
#: Runs that may share a place on average where they are counted by place; where there are fewer than one in FEW words, they are not.
SHARING = 8
FEW = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of its own that ends a piece.
_STOP = "."


def _words(text: Column) -> Column:
    """Words of a text in order, with _STOP between pieces."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(F.regexp_replace(lowered, r"[.,;:!?\x0A-\x0D]+", f" {_STOP} "), r"[ \t]+")


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Tasks read no more than BUCKET_BYTES of lists."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > BUCKET_BYTES:
        spark.conf.set(name, str(BUCKET_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _number(seed: int, lang: Column, word: Column) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


def _seed(counts: DataFrame) -> int:
    """The first seed for which no two words share a number."""
    seed = 0
    while not counts.groupBy(_number(seed, F.col("lang"), F.col("word")).alias("id")).count().where("count > 1").isEmpty():
        seed += 1
    return seed


class Bitmap:
    """Bits of the numbers of frequent runs: a row (at, bits) for 64 bits, in about ``most`` bytes at most."""

    def __init__(self, numbers: DataFrame, rows: int, most: int) -> None:
        #: Few numbers lie apart as they are; more of them share the places there are.
        self.places = None if rows * WORD_BYTES <= most else max(1, most // WORD_BYTES)
        bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
        self.bits = numbers.groupBy(self._at(F.col("number")).alias("at")).agg(F.bit_or(bit).alias("bits"))

    def _at(self, number: Column) -> Column:
        high = F.shiftright(number, 6)
        return high if self.places is None else F.pmod(high, F.lit(self.places))

    def may_have(self, rows: DataFrame, number: Column) -> DataFrame:
        """``rows`` whose ``number`` may be among the frequent ones; all that are stay."""
        asked = rows.withColumn("number", number).withColumn("at", self._at(F.col("number")))
        met = asked.join(F.broadcast(self.bits), "at")
        return met.where(F.expr("shiftrightunsigned(bits, cast(number & 63 as int)) & 1 = 1")).drop("at", "bits", "number")


def _counted(runs: DataFrame, names: list[str], least: int, places: int, most: int) -> DataFrame:
    """Frequent ``runs`` and their number ``f``. With ``places`` (a power of two) runs that share a place are counted
    together first, in short rows, and only those of places with enough of them by themselves."""
    if places:
        place = F.xxhash64(*names).bitwiseAND(F.lit(places - 1))
        crowded = runs.groupBy(place.alias("number")).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
        crowded = stage(crowded.select("number"), "llm-crowded")
        runs = Bitmap(crowded.df, crowded.rows, most).may_have(runs, place)
    return runs.groupBy(*names).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)


def _runs(lists: DataFrame, words: int, frequent: Bitmap) -> DataFrame:
    """(w0, w1, ...): runs of ``words`` words whose first and last part, a word shorter, may be frequent."""
    names = [f"w{i}" for i in range(words)]
    shifted = lists.select(*[F.slice("w", i + 1, 2**30).alias(name) for i, name in enumerate(names)])
    runs = shifted.select(F.inline(F.arrays_zip(*names))).dropna()
    return frequent.may_have(frequent.may_have(runs, F.xxhash64(*names[:-1])), F.xxhash64(*names[1:]))


def _described(pairs: Staged, shorter: Staged) -> Staged:
    """Frequent phrases with their words, and the counts of their beginnings and ends, longest last."""
    left = shorter.df.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_start"), F.col("begins").alias("_begins"))
    right = shorter.df.select(F.col("id").alias("right"), F.col("last").alias("last"), F.col("ends").alias("_ends"))
    named = skew_join(pairs.df, left, "left", spread="id", rows=pairs.rows)
    named = skew_join(named, right, "right", spread="id", rows=pairs.rows)
    return stage(
        named.select(
            "id", "left", "right", "lang", "f", "last",
            F.concat_ws(" ", "_start", "last").alias("phrase"),
            F.concat("_begins", F.array("f")).alias("begins"),
            F.concat("_ends", F.array("f")).alias("ends"),
        ),
        "llm-phrases-named",
    )


def _scored(phrases: DataFrame, words: int) -> DataFrame:
    """Lowest score over all cuts, the shortest first part among equals."""
    cuts = []
    for k in range(1, words):
        l, r = f"begins[{k - 1}]", f"ends[{words - k - 1}]"
        score = f"cast(1000 * cast(f as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)) as decimal(38,0))"
        cuts.append(F.expr(f"named_struct('score', {score}, 'k', {k}, 'l', {l}, 'r', {r})"))
    return phrases.withColumn("cut", F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0])


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, broadcast: int = BROADCAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of every language of ``docs`` (text, lang)."""
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("doc"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with _settings(spark), shuffles_dropped(spark):
        return _mined(texts, min(MOST_BUCKETS, size // BUCKET_BYTES + 1), longest, least, top, broadcast)


def _mined(texts: DataFrame, parts: int, longest: int, least: int, top: int, broadcast: int) -> DataFrame:
    cut = _words(F.col("text"))
    all_words = texts.select("lang", F.explode(cut).alias("word")).where(~F.col("word").isin("", _STOP))
    counts = keep(all_words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")), "word-counts")
    totals = keep(counts.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    occurring = totals.agg(F.sum("n")).first()[0] or 0
    seed = _seed(counts)
    number = F.array(_number(seed, F.col("lang"), F.col("word"))).alias("id")
    one, word = F.array("f"), F.col("word")
    frequent = counts.where(F.col("f") >= least).select(
        number, "lang", "f", word.alias("last"), word.alias("phrase"), one.alias("begins"), one.alias("ends")
    )
    shorter = stage(frequent, "llm-frequent")
    numbers = F.transform(cut, lambda x: F.when(~x.isin("", _STOP), _number(seed, F.col("lang"), x)))
    # texts are dealt out rather than their longer lists
    lists = keep(texts.repartition(parts, "doc").select(numbers.alias("w")), "word-lists")

    lengths: list[Staged] = []
    for n in range(2, longest + 1):
        known = shorter.df.select(F.xxhash64(*[F.get("id", F.lit(i)) for i in range(n - 1)]).alias("number"))
        words = [f"w{i}" for i in range(n)]
        # no more runs are met than there are of the frequent ones a word shorter
        most = shorter.df.agg(F.sum("f")).first()[0] or 0
        places = 1 << (most // SHARING).bit_length() if most > occurring // FEW else 0
        counted = _counted(_runs(lists, n, Bitmap(known, shorter.rows, broadcast)), words, least, places, broadcast)
        pairs = counted.select(
            F.array(*words).alias("id"), F.array(*words[:-1]).alias("left"), F.array(*words[1:]).alias("right"), "f"
        )
        pairs = stage(pairs, "llm-phrase-pairs")
        if not pairs.rows:
            break
        lengths.append(_described(pairs, shorter))
        shorter = lengths[-1]

    empty = "lang string, phrase string, f long, n long, cut struct<score long, k int, l long, r long>"
    scored = [texts.sparkSession.createDataFrame([], empty)]
    for i, phrases in enumerate(lengths):
        own = phrases.df
        if i + 1 < len(lengths):
            next_ = lengths[i + 1].df
            at_left = next_.where(F.col("f") == F.get("begins", F.lit(i + 1))).select(F.col("left").alias("id"))
            at_right = next_.where(F.col("f") == F.get("ends", F.lit(i + 1))).select(F.col("right").alias("id"))
            own = own.join(at_left.unionByName(at_right).distinct(), "id", "left_anti")
        scored.append(_scored(own.join(totals, "lang"), i + 2).select("lang", "phrase", "f", "n", "cut"))
    found = reduce(DataFrame.unionByName, scored)
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    # the rank limit runs before the shuffle, so a task sends at most ``top`` rows per language
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = ranked.select("lang", F.col("rank").cast("long"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    return keep(result, "phrases")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of ``documents``."""
    return mined(table(spark, sf_dir, "documents"))


SQL = """with pieces as (
  select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) as piece
        from documents)),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4, 5]) as k))
  group by 1, 2, 3),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
frequent as (select * from grams where f >= 100),
candidates as (select lang, k, phrase, f, string_split(phrase, ' ') as w from frequent where k > 1),
cuts as (
  select c.lang, c.k as k, c.phrase, c.f as a, x.f as l, y.f as r, n, j,
    (1000::hugeint * c.f * n) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, k)) as j from candidates) c
  join frequent x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
  join frequent y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:c.k], ' ')
  join totals t on t.lang = c.lang),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as nth from cuts),
inner_ as (
  select distinct lang, array_to_string(w[i:i + m - 1], ' ') as phrase, f from (
    select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from candidates))),
held as (select b.* from best b where nth = 1 and not exists (
  select 1 from inner_ q where q.lang = b.lang and q.phrase = b.phrase and 100 * q.f >= 100 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from held)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000"""
