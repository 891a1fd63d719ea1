"""Tokens of two tokenizers aligned over the corpus.

Texts are shuffled by their full text and counted; every distinct one is tokenized once by both
tokenizers and aligned by the byte offsets at which tokens end: where both end, a group ends, and
every stretch between two ends of either is one linked pair of tokens. A text keeps its distinct pairs with
their numbers. Numbers of all texts, weighted by copies, are added up in the tasks and then by pair. The
counts meet the pairs of the texts either as sorted arrays in every task, up to BROADCAST pairs, or, beyond that,
by a join on the pair that spreads common pairs. Measures reach the documents by a SHA-256 digest of the text.

Neither tokenizer joins anything across a single space between two ordinary signs (printable ASCII or
Latin letters), so a text is cut there, and a task tokenizes and aligns a stretch once while it remembers it.

Defined results: texts null, empty or whose tokens' bytes differ from a space and the text have zeros and an empty
digest; rows with equal or null ids are documents each; ties of a count are all highest; an empty table
gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.common import skew_join, stage
from gazette.llm.tables import keep, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The first vocabulary as ranks, by which ordinary stretches are tokenized faster; others go by FIRST.
RANKS = "byte_bpe_50k.tiktoken"
#: Pairs whose counts are still sent to every task: 12 bytes each.
BROADCAST = 4_000_000
#: Stretches a task remembers, those worked on at a time, and pairs added up at a time.
REMEMBERED = 500_000
AT_ONCE = 200_000
ADDED = 4_000_000

_CUT = re.compile(r" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
_PLAIN = re.compile(r"(?: [!-~À-ɏ\n]*[!-~À-ɏ])+")
_BLANK = "▁"
MEASURED = "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _byte_table(path: str) -> list[bytes]:
    """Bytes of every entry of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    entries = dict(model["model"]["vocab"])
    entries.update((t["content"], t["id"]) for t in model.get("added_tokens", []))
    # printable Latin-1 stands for itself, the rest follows from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(letters[c] for c in entry)
    return out


class Pair:
    """Both tokenizers, and what is known of the stretches seen."""

    def __init__(self, first: str, second: str, ranks: str | None = None) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.fast = _ranked(ranks) if ranks else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.a_bytes = _byte_table(first)
        self.wide = self.b.get_piece_size()
        pieces = map(self.b.id_to_piece, range(self.wide))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        # ids as text: of either vocabulary, within a group and last of their side of it
        a, b = len(self.a_bytes), self.wide
        self.names = [f"{i}{end}" for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; no tokens: -1
        self.starts = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int32)

    def _first(self, stretches: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the first tokenizer, and how many each stretch has."""
        if self.fast is not None:
            ids = np.array(self.fast.encode_ordinary("".join(stretches)), np.int64)
            upto = np.searchsorted(np.cumsum(self.a_size[ids]), ends, "right")
            return ids, np.diff(upto, prepend=0)
        return _flat([e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)])

    def learn(self, stretches: list[str]) -> None:
        """Tokenize and align new stretches, each of which begins with a space."""
        plain = [s for s in stretches if _PLAIN.fullmatch(s)]
        if plain:
            ends = np.cumsum(list(map(len, map(str.encode, plain))))
            ids_a, n_a = self._first(plain, ends)
            ids_b, n_b = _flat(self.b.encode([s[1:] for s in plain], num_threads=1))
            whole = "".join(plain).encode()
            if any(b"".join(map(t.__getitem__, i.tolist())) != whole for t, i in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))):
                raise ValueError("a tokenizer changes ordinary signs; it can't be aligned by stretches")
            self._align(plain, np.ones(len(plain), bool), ids_a, n_a, ids_b, n_b)
        if len(plain) == len(stretches):
            return
        rest = [s for s in stretches if not _PLAIN.fullmatch(s)]
        a = [e.ids for e in self.a.encode_batch(rest, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in rest], num_threads=1)
        good = np.ones(len(rest), bool)
        for i, s in enumerate(rest):
            whole = s.encode()
            good[i] = b"".join(map(self.a_bytes.__getitem__, a[i])) == whole == b"".join(map(self.b_bytes.__getitem__, b[i]))
            if not good[i]:
                a[i], b[i] = [], []
        self._align(rest, good, *_flat(a), *_flat(b))

    def _align(
        self, stretches: list[str], good: np.ndarray, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray
    ) -> None:
        """Remember stretches by their tokens: every end of a token ends a link, one of both a group."""
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = ends[1:] == ends[:-1]
        both, ends = ends[1:][twice], ends[np.append(~twice, True)] if len(ends) else ends
        links = ids_a[np.searchsorted(ends_a, ends)] * self.wide + ids_b[np.searchsorted(ends_b, ends)]
        edge = np.append(0, ends_a)[np.cumsum(n_a)]
        upto_links, upto_groups = np.searchsorted(ends, edge, "right"), np.searchsorted(both, edge, "right")
        # tokens by group, those of the first tokenizer before those of the second
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(ids_a)], np.append(group_b[1:] != group_b[:-1], True)[: len(ids_b)]
        names = np.concatenate([ids_a + last_a * len(self.a_bytes), ids_b + last_b * self.wide + 2 * len(self.a_bytes)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts = list(map(self.names.__getitem__, names[order].tolist()))
        upto = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(parts[i:j])[:-1] for i, j in zip([0, *upto], upto)]
        sizes = np.stack([n_a, n_b, np.diff(upto_groups, prepend=0), np.diff(upto_links, prepend=0)], axis=1)
        sizes[~good] = -1
        self.known.update(zip(stretches, range(len(self.sizes), len(self.sizes) + len(stretches))))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + upto_links])
        self.links = np.concatenate([self.links, links.astype(np.int32)])

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """Number of each stretch; new ones are learnt."""
        known = self.known
        new = list({s for s in stretches if s not in known})
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        return np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))

    def linked(self, which: np.ndarray) -> np.ndarray:
        """Linked pairs of the numbered stretches in order."""
        starts, sizes = self.starts[which], self.starts[which + 1] - self.starts[which]
        before = np.cumsum(sizes) - sizes
        return self.links[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


def _ranked(path: str):
    """The first tokenizer from its ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and how many each list has."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and the sum of their times."""
    if not len(pairs):
        return pairs, times
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[first], np.add.reduceat(times[order], first)


def _text_rows(pair: Pair, texts: list[str]) -> Iterator[tuple]:
    """Measures and distinct pairs of each text, few long or many short texts at a time."""
    cut = [_CUT.split(" " + t) for t in texts]
    for parts in cut:
        parts[0] = parts[0][1:]  # the space before is put back for every stretch below
    i = 0
    while i < len(cut):
        j, n = i, 0
        while j < len(cut) and (j == i or n + len(cut[j]) <= AT_ONCE):
            n, j = n + len(cut[j]), j + 1
        yield from _measured_run(pair, cut[i:j])
        i = j


def _measured_run(pair: Pair, cut: list[list[str]]) -> Iterator[tuple]:
    sizes = np.zeros((len(cut), 4), np.int64)
    good = np.ones(len(cut), bool)
    digests = [hashlib.sha256() for _ in cut]
    pairs: list[list[np.ndarray]] = [[] for _ in cut]
    where = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    flat = [" " + s for c in cut for s in c]
    for at in range(0, len(flat), AT_ONCE):
        if len(pair.known) > REMEMBERED:
            pair.forget()
        which, text = pair.numbers(flat[at : at + AT_ONCE]), where[at : at + AT_ONCE]
        own = pair.sizes[which]
        good[text[own[:, 0] < 0]] = False
        first = int(text[0])
        for k in range(4):
            sizes[first : text[-1] + 1, k] += np.bincount(text - first, own[:, k], text[-1] - first + 1).astype(np.int64)
        edges = np.flatnonzero(np.append(True, text[1:] != text[:-1])).tolist() + [len(text)]
        listed = which.tolist()
        for a, b in zip(edges, edges[1:]):
            t = int(text[a])
            body = ";".join(map(pair.groups.__getitem__, listed[a:b]))
            digests[t].update((";" + body if at + a > 0 and where[at + a - 1] == t else body).encode())
        lengths = pair.starts[which + 1] - pair.starts[which]
        codes = np.sort(np.repeat((text - first).astype(np.int64) << 32, lengths) | pair.linked(which))
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(codes)))
        found, owner = codes[heads] & 0xFFFFFFFF, codes[heads] >> 32
        bounds = np.searchsorted(owner, np.arange(text[-1] - first + 2))
        for t in range(int(text[-1]) - first + 1):
            x = slice(int(bounds[t]), int(bounds[t + 1]))
            pairs[first + t].append(np.stack([found[x], times[x]]))
    for t in range(len(cut)):
        if not good[t]:
            yield 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
            continue
        own = pairs[t][0] if len(pairs[t]) == 1 else np.stack(_summed(*np.concatenate(pairs[t], axis=1)))
        yield (*sizes[t].tolist(), digests[t].hexdigest(), own[0].astype(np.int32), own[1].astype(np.int32))


_loaded: dict[tuple[str, str], Pair] = {}


def _pair(first: str | None, second: str | None) -> Pair:
    ranks = None
    if first is None or second is None:
        import public_tokenizers

        ranks = public_tokenizers.path(RANKS) if first is None else None
        first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    if (first, second) not in _loaded:
        _loaded[first, second] = Pair(first, second, ranks)
    return _loaded[first, second]


def measured(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """One row (MEASURED) per distinct text of ``docs`` (text) that has signs; the pair of ids a and b is a times the
    size of the second vocabulary plus b. ``first`` and ``second`` are paths of tokenizer files, by default the
    public ones that every executor has installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for batch in batches:
            digests, copies, texts = batch.columns
            for i in range(0, len(batch), 1024):
                rows = list(zip(*_text_rows(pair, texts.slice(i, 1024).to_pylist())))
                lists = []
                for values in rows[5:]:
                    ends = np.cumsum([0, *map(len, values)])
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int32())))
                plain = [pa.array(x, pa.int64()) for x in rows[:4]] + [pa.array(rows[4], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [digests.slice(i, 1024), copies.slice(i, 1024), *plain, *lists], [x.split()[0] for x in MEASURED.split(", ")]
                )

    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.select(F.sha2("text", 256), "copies", "text").mapInArrow(run, MEASURED)


def pair_counts(texts: DataFrame, wide: int) -> DataFrame:
    """(pair, count, best) over all texts and their copies; best: no pair with the same second id has a larger count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            copies, pairs, times = batch.columns
            lengths = np.diff(np.asarray(pairs.offsets))
            weights = np.asarray(times.flatten(), np.int64) * np.repeat(np.asarray(copies, np.int64), lengths)
            held = [np.concatenate([held[0], np.asarray(pairs.flatten(), np.int64)]), np.concatenate([held[1], weights])]
            if len(held[0]) > ADDED:
                held = list(_summed(*held))
                if len(held[0]) > ADDED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "count"])
                    held = [x[:0] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*held)], ["pair", "count"])

    parts = texts.select("copies", "pairs", "times").mapInArrow(add, "pair long, count long")
    counts = keep(parts.groupBy("pair").agg(F.sum("count").alias("count")), "pair-counts")
    second = F.col("pair") % wide
    # one row per id of the second vocabulary
    highest = counts.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", second).join(F.broadcast(highest), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """Measures of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = keep(measured(docs, first, second), "aligned")
    counts = stage(pair_counts(texts, _pair(first, second).wide), "llm-pairs")
    own = texts.select("digest", "pairs", "times")
    if counts.rows <= broadcast:
        known = counts.df.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(
            (known["pair"].to_numpy().astype(np.int32), known["count"].to_numpy(), np.asarray(known["best"].to_pylist(), bool))
        )

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, count, best = shared.value
            for batch in batches:
                digests, pairs, times = batch.columns
                ends = np.asarray(pairs.offsets)
                at = np.searchsorted(keys, np.asarray(pairs.flatten()))
                times = np.asarray(times.flatten(), np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * count[at])]
                sums = [pa.array(s[ends[1:] - ends[0]] - s[ends[:-1] - ends[0]]) for s in sums]
                yield pa.RecordBatch.from_arrays([digests, *sums], ["digest", "n_best", "count_sum"])

        found = own.mapInArrow(look, "digest string, n_best long, count_sum long")
    else:
        pairs = own.select("digest", F.inline(F.arrays_zip("pairs", "times"))).select("digest", F.col("pairs").cast("long").alias("pair"), "times")
        joined = skew_join(pairs, counts.df, "pair", spread="digest")
        found = joined.groupBy("digest").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
        )
    # one row per distinct text on both sides
    measures = texts.drop("pairs", "times", "copies").join(found, "digest", "left")
    asked = docs.select(F.col("doc_id").cast("long"), F.sha2("text", 256).alias("digest"))
    joined = skew_join(asked, measures, "digest", spread="doc_id", load=texts.select("digest", F.col("copies").alias("rows")), how="left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return joined.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two tokenizers over ``documents``."""
    return aligned(table(spark, sf_dir, "documents"))
