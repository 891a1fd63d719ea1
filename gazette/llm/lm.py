"""Scoring texts with a smoothed n-gram model held as a weighted backoff automaton.

States are the contexts of up to ``order - 1`` tokens that occur in the training texts, arcs
their continuations. An arc carries log10 of (c(uw) + KAPPA * p(w | u')) / (c(u) + KAPPA), a
state's failure arc log10 of KAPPA / (c(u) + KAPPA) and leads to the context without its
first token; the state without context has an arc for every token, (c + 1) / (N + V + 1), and
one for unknown ones. The probabilities of all continuations of a state add up to one.

The model is as large as the corpus makes it, so no task ever holds it. Documents form
blocks of ROWS rows. A block sends its distinct n-grams, as sorted 64-bit keys, to ranges of
the key space, where counts of all blocks are added up, and gets back the totals in the
same order. It then builds the part of the automaton that its own texts can reach, and
traverses all its texts side by side, one token a step from left to right, each carrying its state.

Blocks are numbered by the place of rows in the input, which is read twice and must be the same
each time, as a table is. Tokens are compared by 64-bit hashes. Defined results: null text is
empty and has the end token alone; a null id is a training document; rows with equal ids
are scored each; no training documents at all give counts of zero, so every token has
probability 1 / (0 + 0 + 1); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import tokens
from gazette.llm.tables import keep, table

ORDER = 2
KAPPA = 100.0
#: Rows of a block, and bytes of text per range of keys.
ROWS = 4096
RANGE_BYTES = 32 << 20
END, START = np.uint64(0x517CC1B727220A95), np.uint64(0x2127599BF4325C37)


def _narrow(counts: np.ndarray) -> bytes:
    most = int(counts.max()) if len(counts) else 0
    kind = next(i for i, bits in enumerate((8, 16, 32, 64)) if most < 1 << bits)
    return bytes([kind]) + counts.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()


def _wide(body: bytes) -> np.ndarray:
    return np.frombuffer(body, (np.uint8, np.uint16, np.uint32, np.uint64)[body[0]], offset=1).astype(np.int64)


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by an end token, and where each text begins."""
    h, at = tokens.hashed(texts)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def grams(flow: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1- to ``order``-grams that end at each token."""
    keys = [tokens.mix(flow)]
    older, place = flow, np.arange(len(flow)) - np.repeat(at[:-1], np.diff(at))
    key = flow
    for m in range(1, order):
        older = np.append(START, older[:-1]) if len(older) else older
        older = np.where(place >= m, older, START)
        key = key * np.uint64(0x9FB21C651E98DF25) + tokens.mix(older + np.uint64(m))
        keys.append(tokens.mix(key))
    return keys


class Grams:
    """Distinct keys of one order in a block: sorted, with the place of each token's key."""

    def __init__(self, keys: np.ndarray) -> None:
        by = np.argsort(keys)
        first = np.append(True, keys[by][1:] != keys[by][:-1]) if len(keys) else np.zeros(0, bool)
        self.keys = keys[by][first]
        self.example = by[first]
        self.of = np.empty(len(keys), np.int64)
        self.of[by] = np.cumsum(first) - 1

    def count(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=weights, minlength=len(self.keys)).astype(np.int64)

    def ranges(self, n: int) -> np.ndarray:
        """Bounds of each of ``n`` ranges of the key space."""
        step = [(i << 64) // n for i in range(n)]
        return np.append(np.searchsorted(self.keys, np.array(step, np.uint64)), len(self.keys))


def _numbered(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows with their block."""
    place = F.monotonically_increasing_id()
    block = F.shiftright(place, 33) * (1 << 20) + F.floor(F.pmod(place, F.lit(1 << 33)) / ROWS)
    return docs.select(F.col("doc_id").cast("long"), block.cast("long").alias("block"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")


def counted(rows: DataFrame, order: int) -> DataFrame:
    """Rows ``block, m, range, totals, n, v``: training counts of each block's keys, over all blocks.

    ``n`` and ``v`` add up to the training tokens and the distinct ones.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-size // RANGE_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None

        def out() -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays([b.column("text") for b in held])
            train = ~pa.concat_arrays([b.column("held_out") for b in held]).to_numpy(zero_copy_only=False).astype(bool)
            flow, at = stream(texts)
            weights = np.repeat(train, np.diff(at)).astype(float)
            for m, keys in enumerate(grams(flow, at, order)):
                g = Grams(keys)
                counts, bounds = g.count(weights), g.ranges(n_ranges)
                for r in range(n_ranges):
                    a, b = bounds[r], bounds[r + 1]
                    if a < b:
                        cols = [pa.array([int(r)], pa.int64()), pa.array([block], pa.int64()), pa.array([m], pa.int32()), pa.array([g.keys[a:b].tobytes()], pa.binary()), pa.array([_narrow(counts[a:b])], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=["range", "block", "m", "keys", "counts"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            heads = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for a, b in zip(heads, np.append(heads[1:], len(blocks))):
                if held and blocks[a] != block:
                    yield from out()
                    held.clear()
                block = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        for m, part in pdf.groupby("m"):
            keys = [np.frombuffer(b, np.uint64) for b in part["keys"]]
            every, counts = np.concatenate(keys), np.concatenate([_wide(b) for b in part["counts"]])
            by = np.argsort(every)
            heads = np.flatnonzero(np.append(True, every[by][1:] != every[by][:-1]))
            distinct, totals = every[by][heads], np.add.reduceat(counts[by], heads)
            for i, (block, range_, own) in enumerate(zip(part["block"], part["range"], keys)):
                whole = m == 0 and i == 0
                body = _narrow(totals[np.searchsorted(distinct, own)])
                made.append((block, m, range_, body, int(totals.sum()) if whole else 0, int((totals > 0).sum()) if whole else 0))
        return pd.DataFrame(made, columns=["block", "m", "range", "totals", "n", "v"])

    sent = rows.mapInArrow(send, "range long, block long, m int, keys binary, counts binary")
    return sent.groupBy("range").applyInPandas(add, "block long, m int, range long, totals binary, n long, v long")


class Automaton:
    """The states and arcs that a block's texts can reach."""

    def __init__(self, flow: np.ndarray, at: np.ndarray, totals: list[np.ndarray], n: int, v: int, kappa: float) -> None:
        order = len(totals)
        self.grams = [Grams(k) for k in grams(flow, at, order)]
        self.totals = totals
        begins = np.zeros(len(flow), bool)
        begins[at[:-1]] = True
        end = np.searchsorted(self.grams[0].keys, tokens.mix(np.array([END]))[0])
        texts = totals[0][end] if len(flow) else 0
        # how often the context of m tokens before each token occurs
        self.context = [np.where(begins, texts, np.append(0, t[g.of][:-1]) if len(flow) else t) for g, t in zip(self.grams[:-1], totals[:-1])]
        chance = (totals[0] + 1) / (n + v + 1)
        self.arcs = [np.log10(chance)]
        for m in range(1, order):
            g, eg = self.grams[m], self.grams[m].example
            chance = (totals[m] + kappa * chance[self.grams[m - 1].of[eg]]) / (self.context[m - 1][eg] + kappa)
            self.arcs.append(np.log10(np.maximum(chance, 1e-300)))
        self.failure = [np.log10(kappa / (c + kappa)) for c in self.context]

    def traverse(self, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text; all texts go on by one token a step."""
        order, lengths = len(self.totals), np.diff(at)
        by = np.argsort(-lengths, kind="stable")
        begin, going = at[:-1][by], np.searchsorted(-lengths[by], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right")
        score = np.zeros(len(by))
        # state: tokens of context that the model knows; texts begin in the state of their start
        texts_known = [c[begin] > 0 for c in self.context]
        state = np.zeros(len(by), np.int64)
        for m, known in enumerate(texts_known, 1):
            state[known] = m
        for t, live in enumerate(going):
            i = begin[:live] + t
            s, add, todo = state[:live], np.zeros(live), np.ones(live, bool)
            for m in range(order - 1, 0, -1):
                here = np.flatnonzero(todo & (s >= m))
                gram = self.grams[m].of[i[here]]
                arc = self.totals[m][gram] > 0
                add[here[arc]] += self.arcs[m][gram[arc]]
                add[here[~arc]] += self.failure[m - 1][i[here[~arc]]]
                todo[here[arc]] = False
            rest = np.flatnonzero(todo)
            add[rest] += self.arcs[0][self.grams[0].of[i[rest]]]
            score[:live] += add
            now = np.zeros(live, np.int64)
            for m in range(1, order):
                now[self.totals[m - 1][self.grams[m - 1].of[i]] > 0] = m
            state[:live] = now
        out = np.zeros(len(by))
        out[by] = score
        return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, held_out: Column, order: int = ORDER, kappa: float = KAPPA) -> DataFrame:
    """Score of every row of ``docs`` (doc_id, text) by a model of those rows that are not held out."""
    rows = _numbered(docs, held_out)
    totals = keep(counted(rows, order), "grams")
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def score(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])
        flow, at = stream(pa.array(own["text"], pa.large_string()))
        # rows meet in any order, which changes neither the keys nor their sorted order
        parts = {m: [_wide(b) for b in p.sort_values("range")["totals"]] for m, p in found.groupby("m")}
        sums = [np.concatenate(parts[m]) for m in range(order)]
        automaton = Automaton(flow, at, sums, n, v, kappa)
        known = sums[0][automaton.grams[0].of] > 0
        base = automaton.arcs[0][automaton.grams[0].of]
        whole = lambda x: np.add.reduceat(x, at[:-1])
        return pd.DataFrame(
            {
                "doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": np.diff(at), "n_known": whole(known.astype(np.int64)),
                "train_tokens": n, "base_score": whole(base), "score": automaton.traverse(at),
            }
        )

    return rows.groupBy("block").cogroup(totals.select("block", "m", "range", "totals").groupBy("block")).applyInPandas(score, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; those whose checksum leaves remainder 2 by 7 are held out."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return scored(table(spark, sf_dir, "documents"), held_out)
