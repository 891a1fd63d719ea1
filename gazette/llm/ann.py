"""Approximate nearest neighbours by an inverted multi-index over inner products.

A vector is cut into two halves and each half is put to the nearest of CENTROIDS centroids, so
the index has a cell for every pair of centroids. A query visits the pairs in the order of
summed nearness of the two halves, taken from a heap, until the visited cells hold the share
VISITED of all vectors and FLOOR times as many entries as are asked for, and the entries of these cells are reranked by their exact inner
products. The share is high because it must do for vectors without clusters: of unit vectors
spread evenly over 64 dimensions, a smaller one finds fewer than nine of ten neighbours.

The centroids are fitted on the SAMPLE vectors of smallest hash; every vector is indexed.
Cells are dealt into BUCKETS, buckets split into parts of about PART entries and the queries of
a bucket into parts as well, so a cell that holds a third of all vectors is many tasks. Numbers per
cell or bucket are tables of at most CENTROIDS**2 rows.

Defined results: vectors that are null, empty, all zero, of another length than the most
frequent one (of two as frequent, the shorter), or hold a null, NaN or infinity take no part, as query or as candidate; null ids neither; rows with the query's own
id are no candidates; ties go to the smaller id; no valid vectors give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.tables import keep, table

CENTROIDS = 32
SAMPLE = 20_000
VISITED = 0.6
FLOOR = 10
BUCKETS = 32
PART = 4096
QUERIES = 4096
#: Products computed again at a time.
PAIRS = 1 << 15
NEAREST = 20


def valid(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, v`` (doubles) that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & ~_broken("v") & F.exists("v", lambda x: x != 0))


def _broken(name: str) -> Column:
    """Whether an array holds a null, NaN or infinity."""
    return F.coalesce(F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from points spread over the sample; an emptied centroid stays where it is."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


class Codebook:
    """Centroids of both halves."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.width, self.half = sample.shape[1], sample.shape[1] // 2
        parts = (sample[:, : self.half], sample[:, self.half :])
        self.centres = [_means(p, k) if p.shape[1] else np.zeros((1, 0)) for p in parts]

    def cells(self, v: np.ndarray) -> np.ndarray:
        first, second = _nearest(v[:, : self.half], self.centres[0]), _nearest(v[:, self.half :], self.centres[1])
        return first * len(self.centres[1]) + second

    def visit(self, q: np.ndarray, sizes: dict[int, int], entries: float) -> Iterator[int]:
        """Cells with entries, nearest pairs first, until ``entries`` are reached."""
        a, b = self.centres[0] @ q[: self.half], self.centres[1] @ q[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, held = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)], 0
        while heap and held < entries:
            _, i, j = heapq.heappop(heap)
            cell = int(by_a[i]) * len(b) + int(by_b[j])
            if size := sizes.get(cell):
                held += size
                yield cell
            # each pair is pushed once: along the row always, down a column from its first
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[by_a[i]] + b[by_b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[by_a[i + 1]] + b[by_b[0]]), i + 1, 0))


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, visited: float = VISITED, centroids: int = CENTROIDS) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` for every row of ``vectors`` that ``is_query`` picks."""
    rows = valid(vectors)
    spark = rows.sparkSession
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return none
    width = widths[0]["width"]
    rows = rows.where(F.size("v") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]  # SAMPLE vectors at most
    book = Codebook(np.array(sample.tolist()), centroids)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cell": book.cells(v), "v": pdf["v"]})

    index = keep(rows.mapInPandas(place, "vec_id long, cell int, v array<double>"), "cells")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # at most centroids**2 rows

    load: dict[int, int] = {}
    for cell, n in sizes.items():
        load[cell % BUCKETS] = load.get(cell % BUCKETS, 0) + n
    entries = visited * sum(sizes.values())

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for id_, q, own in zip(pdf["vec_id"], pdf["v"], pdf["own"]):
                cells: dict[int, list[int]] = {}
                for cell in book.visit(np.asarray(q), sizes, max(entries, FLOOR * k + own)):
                    cells.setdefault(cell % BUCKETS, []).append(cell)
                made += [(id_, bucket, own, q) for bucket, own in cells.items()]
            yield pd.DataFrame(made, columns=["query_id", "bucket", "cells", "q"])

    # rows with the query's own id are no candidates, however many there are
    asked = index.where(is_query).groupBy("vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("own"))
    turns = max(1, -(-asked.count() // QUERIES))
    probes = asked.mapInPandas(probe, "query_id long, bucket int, cells array<int>, q array<double>")
    parts = F.element_at(F.create_map(*[F.lit(x) for b, n in load.items() for x in (b, -(-n // PART))]), F.col("bucket"))
    held = index.withColumn("bucket", F.col("cell") % BUCKETS).withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    sent = probes.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    keys = ["bucket", "part", "turn"]

    def rerank(queries: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(queries) and len(entries_):
            ids, cells, v = entries_["vec_id"].to_numpy(), entries_["cell"].to_numpy(), np.stack(entries_["v"].to_numpy())
            long = np.abs(v).max() * v.shape[1]
            for i in range(0, len(queries), 256):
                part = queries.iloc[i : i + 256]
                own, q = part["query_id"].to_numpy(), np.stack(part["q"].to_numpy())
                s = q @ v.T
                seen = np.zeros((len(part), centroids * centroids), bool)
                for row, visits in zip(seen, part["cells"]):
                    row[visits] = True
                s[~seen[:, cells] | (own[:, None] == ids[None, :])] = -np.inf
                # the matrix product rounds equal vectors differently: what may be among the best is computed again, one by one
                least = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
                slack = 1e-12 * long * np.abs(q).max(axis=1)
                row, col = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
                score = np.zeros(len(row))
                for a in range(0, len(row), PAIRS):  # copies of one vector tie by the thousand
                    score[a : a + PAIRS] = (q[row[a : a + PAIRS]] * v[col[a : a + PAIRS]]).sum(axis=1)
                by = np.lexsort((ids[col], -score, row))
                row, col, score = row[by], col[by], score[by]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < k
                made.append(pd.DataFrame({"query_id": own[row[ok]], "vec_id": ids[col[ok]], "score": score[ok]}))
        return pd.concat(made)

    near = sent.select("query_id", "cells", "q", *keys).groupBy(*keys).cogroup(held.select("vec_id", "cell", "v", *keys).groupBy(*keys))
    near = near.applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
