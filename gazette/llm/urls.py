"""URL filter over a sorted array of 64-bit digests.

A rule is a host and the beginning of a path, with a verdict. The 64-bit xxhash of every
rule is kept in a sorted array on disk, beside the rules themselves; each task maps the
files into memory. A url's candidates, its host and every parent domain joined with the
beginnings of its path of the lengths that rules have, are hashed for a whole batch and
found by one binary search; a hit counts only if the stored rule equals the candidate, so
digest collisions change nothing. The longest rule wins. Without a rule the verdict is the
filter's default, allow.

Defined results: a null url or one without "://" has empty host and path, no rule and the
default verdict; a host that is not null but empty matches no rule; repeated rows are judged
each; a rule given twice must have one verdict; an empty list of rules gives the default for all.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.tables import table

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: A list of rules goes to every executor as files; larger lists are refused, not cut.
MOST_BYTES = 1 << 31


@dataclass(frozen=True)
class Array:
    """Names of the four files of one array, and the lengths of its rules' paths."""

    name: str
    lengths: tuple[int, ...]
    hosts: tuple[int, int]


def build(spark: SparkSession, rules: list[tuple[str, str, str]]) -> Array:
    """Sort the digests of ``rules`` (verdict, host, path) and hand the files to all executors."""
    verdicts: dict[bytes, str] = {}
    for verdict, host, path in rules:
        key = f"{host}{path}".encode()
        if verdicts.setdefault(key, verdict) != verdict:
            raise ValueError(f"two verdicts for {host}{path}")
    size = sum(map(len, verdicts)) + 17 * len(verdicts)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of rules; the limit is {MOST_BYTES}")
    pairs = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in verdicts.items())
    name = f"urls-{uuid.uuid4().hex}"
    # Spark serves added files from where they are, so the driver keeps them for its lifetime
    folder = tempfile.mkdtemp(prefix=name)
    ends = np.cumsum([0, *[len(k) for _, k, _ in pairs]]).astype("<i8")
    parts = {
        "digests": np.array([d for d, _, _ in pairs], "<u8").tobytes(),
        "ends": ends.tobytes(),
        "rules": b"".join(k for _, k, _ in pairs),
        "verdicts": bytes(v == "block" for _, _, v in pairs),
    }
    for part, body in parts.items():
        at = os.path.join(folder, f"{name}.{part}")
        with open(at, "wb") as f:
            f.write(body or b"\0")  # an empty file can't be mapped
        spark.sparkContext.addFile(at)
    dots = [h.count(".") + 1 for _, h, _ in rules] or [1]
    return Array(name, tuple(sorted({len(p) for _, _, p in rules})), (min(dots), max(dots)) if pairs else (1, 0))


class Mapped:
    """The files of an array, mapped into memory."""

    def __init__(self, name: str, n: int | None = None) -> None:
        at = lambda part: SparkFiles.get(f"{name}.{part}")
        self.ends = np.memmap(at("ends"), "<i8", "r")
        n = len(self.ends) - 1
        self.digests = np.memmap(at("digests"), "<u8", "r")[:n] if n else np.zeros(0, "<u8")
        self.rules = np.memmap(at("rules"), np.uint8, "r")
        self.blocks = np.memmap(at("verdicts"), np.uint8, "r")

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, -1 where it isn't stored."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        place = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1, np.int64)
        hits = np.flatnonzero(place < len(self.digests))
        hits = hits[self.digests[place[hits]] == digests[hits]]
        for i in hits:
            at = int(place[i])
            while at < len(self.digests) and self.digests[at] == digests[i]:  # rules that share a digest
                if self.rules[self.ends[at] : self.ends[at + 1]].tobytes() == keys[i]:
                    out[i] = at
                    break
                at += 1
        return out


_mapped: dict[str, Mapped] = {}


def _candidates(host: str, path: str, lengths: tuple[int, ...], dots: tuple[int, int]) -> Iterator[bytes]:
    """Host and parent domains with beginnings of the path."""
    labels = host.split(".")
    for n in range(min(dots[1], len(labels)), dots[0] - 1, -1):
        domain = ".".join(labels[len(labels) - n :])
        for m in lengths:
            if m <= len(path) and domain:
                yield f"{domain}{path[:m]}".encode()


def judged(rows: DataFrame, array: Array, default: str = DEFAULT) -> DataFrame:
    """``rows`` (with url) and host, path, rule and verdict.

    Columns of the input called host, path, rule or verdict are replaced.
    """
    made = ["host", "path", "rule", "verdict"]
    rows = rows.drop(*made)
    from_ = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(from_, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    rows = rows.withColumn("host", host).withColumn("path", path)
    schema = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if array.name not in _mapped:
            _mapped[array.name] = Mapped(array.name)
        files = _mapped[array.name]
        for pdf in batches:
            lists = [list(_candidates(h, p, array.lengths, array.hosts)) for h, p in zip(pdf["host"], pdf["path"])]
            keys = [k for ks in lists for k in ks]
            found = files.find(keys)
            rules, verdicts, i = [], [], 0
            for ks in lists:
                own = [(len(keys[j]), keys[j], found[j]) for j in range(i, i + len(ks)) if found[j] >= 0]
                i += len(ks)
                _, key, at = max(own, default=(0, None, -1))
                rules.append(key.decode() if key else None)
                verdicts.append(("block" if files.blocks[at] else "allow") if key else default)
            yield pdf.assign(rule=pd.Series(rules, dtype=object, index=pdf.index), verdict=pd.Series(verdicts, dtype=object, index=pdf.index))

    return rows.mapInPandas(judge, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), build(spark, list(RULES))).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH r(verdict, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT page_id, host, path, (SELECT {{'rule': h || p, 'verdict': verdict}} FROM r
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS best FROM s)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{DEFAULT}') AS verdict FROM b"""


SQL = _sql()
