"""Language of a text by Bayesian fusion of what is known about it.

The text gives log likelihoods under byte-trigram models, one per language and one of evenly
spread trigrams for text in none of them; they are fitted on all rows with a declared
language. Likelihoods are tempered to those of at most TEMPER trigrams, since trigrams of one text
are not independent. To these are added the log probability of the declared language (markup
or a column) given each language, counted over all rows, and a prior: shares of languages per
host, smoothed toward those of its domain, these toward those of the address suffix and these
toward all, all counted by grouped aggregation of what the texts alone say, a row's own say left
out. The posterior is normalised, and a row is kept if its best language is one of the
models' and likely enough.

Defined results: text without trigrams (null, empty) is "und", confidence 0, not kept; a null
or unknown declared language is evidence of its own kind; a null host is a host, an address
without suffix has an empty one; repeated rows count each; an empty table gives an empty
result; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.common import let
from gazette.llm import tokens
from gazette.llm.tables import keep, table

LANGUAGES = ("de", "en", "es", "fr")
NONE = "und"
#: Cells are the upper 16 bits of a trigram's hash.
CELLS = 1 << 16
TEMPER = 150
#: Rows that a level of the prior weighs against the next; weight of a declared language's count.
STRENGTH = 5.0
LEAST = 0.5


def _cells(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, trigram cells and where each text's cells begin, for one stretch of about STEP bytes after another.

    Letters count, in lower case; everything else is a blank. A text longer than a stretch comes in several,
    each of which reads two bytes into the next, so no trigram is lost.
    """
    data, ends = tokens.raw(texts)
    for i, j in tokens._groups(ends):
        for a in range(int(ends[i]), int(ends[j]), tokens.STEP) if j == i + 1 else [int(ends[i])]:
            b = min(a + tokens.STEP, int(ends[j]))
            part = data[a : min(b + 2, int(ends[j]))]
            if len(part) < 3:
                continue
            folded = np.where(_LETTERS[part], tokens._LOWER[part], 32).astype(np.uint32)
            code = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)
            code = (code ^ (code >> 15)) * np.uint32(0x2C1B3C6D)
            inside = ~((folded[:-2] == 32) & (folded[1:-1] == 32))
            at = np.clip(ends[i : j + 1] - a, 0, len(code))
            for back in (1, 2):  # trigrams across two texts
                cut = ends[i + 1 : j] - a - back
                inside[cut[(cut >= 0) & (cut < len(code))]] = False
            before = np.append(0, np.cumsum(inside, dtype=np.int32))
            yield i, (code[inside] >> 16).astype(np.int32), before[at]


_LETTERS = np.zeros(256, bool)
_LETTERS[128:] = True
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def fitted(rows: DataFrame) -> np.ndarray:
    """Log likelihood of every cell per language, and of the even spread: a table of fixed size."""
    n = len(LANGUAGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, CELLS), np.int64)
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            for i, cell, at in _cells(batch.column(1)):
                own = np.repeat(lang[i : i + len(at) - 1], np.diff(at)) * CELLS + cell
                counts += np.bincount(own, minlength=n * CELLS).reshape(n, CELLS)
        for i, own in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["lang", "counts"])

    def add(key: tuple, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame({"lang": [key[0]], "counts": [sum(np.frombuffer(b, np.int64) for b in pdf["counts"]).tobytes()]})

    schema = "lang int, counts binary"
    place = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("declared")) - 1
    known = rows.where(F.col("declared").isin(*LANGUAGES)).select(place.cast("int").alias("lang"), "text")
    table_ = np.zeros((n + 1, CELLS))
    for row in known.mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).collect():  # one row per language
        table_[row["lang"]] = np.frombuffer(row["counts"], np.int64)
    table_ += 0.5
    return np.log(table_ / table_.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` without text but with ``grams`` and ``ll``, the tempered log likelihoods."""
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T.astype(np.float32)))
    names = [c for c in rows.columns if c != "text"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, grams = np.zeros((len(batch), len(model))), np.zeros(len(batch), np.int64)
            for i, cell, at in _cells(batch.column("text")):
                n = np.diff(at)
                full = np.flatnonzero(n)
                if len(full):
                    sums[i + full] += np.add.reduceat(held.value[cell], at[:-1][full], axis=0, dtype=np.float64)
                grams[i : i + len(n)] += n
            ll = sums / np.maximum(grams, 1)[:, None] * np.minimum(grams, TEMPER)[:, None]
            offsets = pa.array(np.arange(len(ll) + 1) * len(model), pa.int32())
            cols = [batch.column(c) for c in names] + [pa.array(grams, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ll.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "grams", "ll"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.select(*names, "text").mapInArrow(weigh, f"{kinds}, grams long, ll array<double>")


def _best(values: Column) -> Column:
    """First place of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def identified(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``rows`` (text, declared, host, domain, suffix and ids) with lang, confidence and kept, without text.

    ``declared`` is a language code or null. The rows are read twice.
    """
    names = [c for c in rows.columns if c != "text"]
    n = len(LANGUAGES) + 1
    seen = keep(text_evidence(rows, fitted(rows)), "language")
    top = F.when(F.col("grams") > 0, _best(F.col("ll")))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("declared")), F.when(F.col("declared").isNull(), n + 1).otherwise(0)).cast("int")
    seen = seen.withColumn("_top", top).withColumn("_kind", kind)
    said = [F.count_if(F.col("_top") == i).cast("double").alias(f"n{i}") for i in range(n)]
    cols = [f"n{i}" for i in range(n)]

    # at most (languages + 1) * (languages + 2) rows
    told = {(r["_kind"], r["_top"]): r["n"] for r in seen.where("_top IS NOT NULL").groupBy("_kind", "_top").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [sum(v for (_, t), v in told.items() if t == i) for i in range(n)]
    claim = [[float(np.log((told.get((k, i), 0) + 1) / (totals[i] + n + 2))) for i in range(n)] for k in range(n + 2)]
    claims = F.array(*[F.array(*map(F.lit, c)) for c in claim])

    overall = float(sum(totals) + n)
    share = [(t + 1) / overall for t in totals]
    hosts = seen.groupBy("host", "domain", "suffix").agg(*said)

    def smoothed(inner: DataFrame, level: str, above: list[Column]) -> DataFrame:
        """``inner`` with the shares of ``level``, smoothed toward those in ``above``."""
        sums = inner.groupBy(F.col(level).alias("_key")).agg(*[F.sum(c).alias(f"_{c}") for c in cols])
        joined = inner.join(sums, inner[level].eqNullSafe(sums["_key"]), "left")
        all_ = reduce(lambda a, b: a + b, [F.col(f"_{c}") for c in cols])
        for i, c in enumerate(cols):
            joined = joined.withColumn(f"{level}{i}", (F.col(f"_{c}") + STRENGTH * above[i]) / (all_ + STRENGTH))
        return joined.drop("_key", *[f"_{c}" for c in cols])

    hosts = smoothed(hosts, "suffix", [F.lit(s) for s in share])
    hosts = smoothed(hosts, "domain", [F.col(f"suffix{i}") for i in range(n)])
    hosts = hosts.select(F.col("host").alias("_host"), F.col("domain").alias("_domain"), F.col("suffix").alias("_suffix"), F.array(*cols).alias("_said"), F.array(*[F.col(f"domain{i}") for i in range(n)]).alias("_above"))
    same = seen["host"].eqNullSafe(hosts["_host"]) & seen["domain"].eqNullSafe(hosts["_domain"]) & seen["suffix"].eqNullSafe(hosts["_suffix"])
    joined = seen.join(hosts, same, "left")
    own = lambda i: (F.coalesce(F.col("_top"), F.lit(-1)) == i).cast("double")
    all_ = F.aggregate("_said", F.lit(0.0), lambda a, x: a + x) - F.when(F.col("_top").isNotNull(), 1.0).otherwise(0.0)
    logs = F.array(
        *[
            F.get("ll", F.lit(i)) + F.get(F.get(claims, F.col("_kind")), F.lit(i))
            + F.log((F.get("_said", F.lit(i)) - own(i) + STRENGTH * F.get("_above", F.lit(i))) / (all_ + STRENGTH))
            for i in range(n)
        ]
    )
    best = let(logs, lambda p: F.struct(_best(p).alias("at"), (1 / F.aggregate(p, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(p)))).alias("p")))
    rows = joined.withColumn("_best", best)
    some = F.col("grams") > 0
    lang = F.when(some, F.get(F.array(*map(F.lit, [*LANGUAGES, NONE])), F.col("_best.at"))).otherwise(NONE)
    sure = F.when(some, F.col("_best.p")).otherwise(0.0)
    return rows.select(*names, lang.alias("_lang"), sure.alias("confidence")).withColumn("kept", (F.col("_lang") != NONE) & (F.col("confidence") >= least))


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows to identify: the language column is declared, the source is the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), *_document_columns())


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: language of the markup, else of the first part of the path; host, its last two labels, its last."""
    host = F.lower(F.regexp_extract("url", r"(?s)^[^:]*://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    markup = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    path = F.lower(F.regexp_extract("url", r"(?s)^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"),
        F.coalesce(F.nullif(markup, F.lit("")), F.nullif(path, F.lit(""))).alias("declared"), host.alias("host"),
        F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is found, with their own columns."""
    whole = docs.select(F.monotonically_increasing_id().alias("_at"), F.struct("*").alias("_row"))
    rows = whole.select("_at", *[F.col(f"_row.{c}").alias(c) for c in ["doc_id", "text", "lang", "source"]])
    found = identified(rows.select("_at", *_document_columns()))
    dropped = found.where("NOT kept").select("_at")
    return whole.join(dropped, "_at", "left_anti").select("_row.*")


def _document_columns() -> list[Column]:
    source = F.col("source").cast("string")
    return [F.col("text"), F.lower(F.col("lang")).alias("declared"), source.alias("host"), source.alias("domain"), F.lit("").alias("suffix")]


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page."""
    rows = of_documents(table(spark, sf_dir, "documents")).unionByName(of_pages(table(spark, sf_dir, "pages")))
    return identified(rows).select("doc_id", "page_id", "declared", F.col("_lang").alias("lang"), F.round("confidence", 6).alias("confidence"), "kept")
