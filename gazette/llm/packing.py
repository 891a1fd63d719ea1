"""Best-fit decreasing packing of token sequences.

Documents are tokenized, ended with one id and cut only where longer than a sequence. The
pieces are dealt into groups by where they stand in the input; in each group the longest
piece goes first, into the open sequence that it leaves fullest. A segment tree over the
remaining capacities finds that sequence in logarithmic time. A piece of full length is a
sequence of its own. Groups are packed apart, which costs at most about one sequence each.

Defined results: null text is empty and gives one piece with the end id alone; rows with
equal or null ids are separate documents; an empty table gives no pieces; further columns of
the input are not carried into the pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm import tokens
from gazette.llm.tables import table

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one task are dealt to this many packing groups per GROUP_ROWS input rows.
GROUP_ROWS = 65536
#: Words whose ids a worker remembers, all their ids, and texts tokenized at a time.
SLOTS = 1 << 21
POOL = 8_000_000
TEXTS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _group long"


class Merges:
    """Byte-pair merges of many short words at once, for a vocabulary with word ends.

    Words of one round are merged together: each takes its lowest-ranked pair, as the
    vocabulary's rule says. Only for words of ASCII signs and two-byte Latin letters, whose
    pieces need no Unicode tables; others go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # the byte alphabet: printable Latin-1 stands for itself, the rest follows from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NEVER, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        self.probes = 1
        for i, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist())):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & ((1 << self.bits) - 1), n + 1
            self.probes = max(self.probes, n)
            self.keys[slot], self.rank[slot], self.made[slot] = key, i, vocab["".join(pairs[i])]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; a slot that isn't the pair's has rank NEVER in what is returned."""
        keys = (left << 20) | right
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys
            out[todo[hit]] = slot[hit]
            go = ~hit & (held >= 0)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out

    @staticmethod
    def simple(words: list[bytes]) -> np.ndarray:
        """Which words are made of signs whose classes need no Unicode tables."""
        data = np.frombuffer(b"".join(words) + b" ", np.uint8)
        ends = np.cumsum([0, *map(len, words)])
        pair = np.zeros(len(data), bool)
        pair[1:] = data[:-1] == 0xC3
        good = np.where(pair, _LETTER[data], _SIGN[data])
        good[:-1] &= ~((data[:-1] == 60) & (data[1:] == 124))  # "<|" begins a special token
        return np.logical_and.reduceat(good, ends[:-1]) if len(words) else np.zeros(0, bool)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and where each word's ids begin."""
        data = _FOLD[np.frombuffer(b"".join(words), np.uint8)]
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        upper = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data = np.where(upper, data + 0x20, data).astype(np.uint8)
        kind = np.where(after, 1, _KIND[data])  # 1 letters, 2 digits, 0 others
        starts = np.cumsum([0, *map(len, words)])
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first[starts[:-1]] = True
        segment = np.cumsum(first) - 1
        final = np.append(first[1:], True)
        symbols = np.where(final, self.last[data], self.inner[data])
        done_at, done = [], []
        while len(symbols):
            same = segment[1:] == segment[:-1]
            slots = np.full(len(same), -1, np.int64)
            slots[same] = self._find(symbols[:-1][same], symbols[1:][same])
            rank = np.append(np.where(slots >= 0, self.rank[slots], NEVER), NEVER)
            heads = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            best = np.repeat(best, sizes)
            over = best == NEVER
            if over.any():
                done_at.append(segment[over])
                done.append(symbols[over])
            chosen = (rank == best) & ~over
            # of overlapping equal pairs every second one is merged, from the left
            where = np.flatnonzero(chosen)
            runs = np.append(True, np.diff(where) != 1) if len(where) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(runs, np.arange(len(where)), 0)) if len(where) else where
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            symbols[where] = self.made[slots[where]]
            stay = ~over
            stay[where + 1] = False
            symbols, segment = symbols[stay], segment[stay]
        at = np.concatenate(done_at) if done_at else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        ids = (np.concatenate(done)[order] if done else np.zeros(0)).astype(np.uint32)
        word_of = np.searchsorted(starts, np.flatnonzero(first), "right") - 1
        return ids, np.searchsorted(word_of[at[order]], np.arange(len(words) + 1))


NEVER = 1 << 40
#: ASCII signs but the apostrophe, with the first byte of a Latin letter; its second byte.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[[39, 0xC3]] = False, True
_LETTER = np.zeros(256, bool)
_LETTER[0x80:0xC0] = True
_LETTER[[0x97, 0xB7]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.int8)
_KIND[97:123] = 1
_KIND[0xC3] = 1
_KIND[48:58] = 2


class Ids:
    """Token ids of texts, each distinct word being tokenized once while it is remembered.

    The vocabulary drops white space and never joins across it, so the ids of a text are the
    ids of its words. Words are remembered in a table by hash; a later word takes the slot.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.begin = np.zeros(SLOTS, np.int64)
        self.length = np.full(SLOTS, -1, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in order, and where each word's ids begin."""
        simple = self.merges.simple(words)
        ids, at = self.merges.ids([w for w, s in zip(words, simple) if s])
        rest = self.model.encode_batch([w.decode() for w, s in zip(words, simple) if not s], add_special_tokens=False)
        flat = np.concatenate([ids, *[np.array(e.ids, np.uint32) for e in rest]])
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[simple], starts[simple] = np.diff(at), at[:-1]
        lengths[~simple] = [len(e.ids) for e in rest]
        starts[~simple] = len(ids) + np.cumsum([0, *lengths[~simple]])[:-1]
        return _gather(flat, starts, lengths)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids before each text."""
        data, ends = tokens.raw(texts)
        starts, stops, before = tokens.spans(data, ends)
        h, _ = tokens.hashed(texts, lower=False)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.keys[slot] == h) & (self.length[slot] >= 0)
        begin, length = self.begin[slot], self.length[slot].astype(np.int64)
        pool, missing = self.pool, np.flatnonzero(~known)
        if len(missing):
            order = missing[np.argsort(h[missing])]
            firsts = np.append(True, h[order][1:] != h[order][:-1])
            whole = data.tobytes()
            ids, at = self._learn([whole[starts[i] : stops[i]] for i in order[firsts]])
            group = np.cumsum(firsts) - 1
            begin[order], length[order] = len(pool) + at[:-1][group], np.diff(at)[group]
            pool = np.concatenate([pool, ids])
            new = order[firsts]
            self.keys[slot[new]], self.begin[slot[new]], self.length[slot[new]] = h[new], begin[new], length[new]
            self.pool = pool
            if len(pool) > POOL:
                self.forget()
        ids, at = _gather(pool, begin, length)
        return ids, at[before]


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[start : start + length], and where each begins."""
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    where = np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)
    return flat[where], at


_loaded: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids as little-endian unsigned 32-bit binary.

    ``vocabulary`` is the path of a tokenizer file, by default the public one that every
    executor has installed.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        else:
            path = vocabulary
        ids_of, seen = _ids(path), 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for i in range(0, len(whole), TEXTS):
                batch = whole.slice(i, TEXTS)
                ids, at = ids_of.of(batch.column(1))
                rows: list[tuple] = []
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    group = hash((part, seen // GROUP_ROWS, seen % 64)) & 0x7FFFFFFFFFFFFFFF
                    seen += 1
                    for n, start in enumerate(range(0, len(own), capacity)):
                        body = own[start : start + capacity].tobytes()
                        rows.append((doc, n, start, len(body) // 4, zlib.crc32(body), body if with_ids else None, group))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Capacities:
    """Segment tree: how many open sequences have each remaining capacity, and which."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += change
            node >>= 1

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the open sequence of least capacity that is at least ``need``."""
        node = need + self.leaves
        if not self.open[node]:
            # up to the first right sibling with an open sequence, then down its left side
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each length, by best-fit decreasing."""
    tree, used = Capacities(capacity), 0
    place, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        if found is None:
            left, bin_, used = capacity, used, used + 1
        else:
            left, bin_ = found
        place[i], offset[i] = bin_, capacity - left
        if left > lengths[i]:
            tree.put(left - lengths[i], bin_)
    return place, offset


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The number of groups follows from the number of pieces, so groups hold about
    GROUP_ROWS pieces whatever the size of the input; their ids are dealt by hash.
    """
    full, rest = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # numbers of full pieces are negative, those of packed ones carry their group
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place, offset = best_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(sequence_id=np.asarray(place, np.int64) + (int(key[0]) << 32), offset=np.asarray(offset, np.int64))

    groups = max(1, -(-rest.count() // GROUP_ROWS))
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_group"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("_group").applyInPandas(fill, schema))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    from gazette.llm.tables import keep

    rows = keep(pieces(table(spark, sf_dir, "documents"), with_ids=False).drop("ids"), "pieces")
    return pack(rows).drop("_group")
