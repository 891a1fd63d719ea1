"""Personal data, phrases and tokenizer alignment against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette import common
from gazette.llm import align, jaccard, lm, packing, phrases, pii, queries, tokens
from tools.check import TABLES, _rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n int, kind string, phrase string, digest string, f long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, l, 1, "clash", "clash", "clash", 2) for i, t, l in rows], DOCS)


def by_sql(sql, rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    if rows:
        db.executemany("insert into documents values (?, ?, ?)", rows)
    return Counter(db.execute(sql).fetchall())


# --- personal data ---------------------------------------------------------------------


def plain_base(text):
    """The base patterns as they are written, on the whole text."""
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PARTS = [
    "a@b.c", ".", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", " tel ", "Tel: ", " ",
    "é", "555-123-4567", "(555) 123-4567", "01 23 45 67 89", "0123456789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
    "FR76 3000 6000 0112 3456 7890 189", "NO9386011117947", " IS", "X", "0", "-", "+", "(", "\n", "iban ", "nir ", "1 85 05 78 006 084 91",
    "185057800608491", "%", "1", "0000000000000000",
]


@pytest.fixture(scope="module")
def private():
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    return [(i, t, None) for i, t in enumerate(texts)] + [(1, None, "x"), (None, "", "x"), (None, "a@b.c", "x"), (None, "a@b.c", "x")]


def test_base_spans_are_those_of_the_plain_patterns(private):
    for _, text, _ in private:
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.base] == plain_base(text)


def test_personal_data_equals_sql(spark, private, monkeypatch):
    docs = table_of(spark, private)
    monkeypatch.setattr(pii, "table", lambda *_: docs)
    assert Counter(map(tuple, pii.op11_pii(spark, "").collect())) == by_sql(pii.SQL, private)


def test_added_spans_need_confirmation_or_context():
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.find(t)]
    assert kinds("to GB82 WEST 1234 5698 7654 32 NOW") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("to GB83 WEST 1234 5698 7654 32 NOW") == []
    assert kinds("no 1 85 05 78 006 084 91") == [("nir", "1 85 05 78 006 084 91")]
    assert kinds("555-123-4567") == [] and kinds("tél. 555-123-4567") == [("phone", "555-123-4567")]
    assert kinds("tel +1 555-123-4567") == [("phone", "+1 555-123-4567")]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_text_without_personal_data_stays(spark):
    docs = table_of(spark, [(1, "Version 1.2.3 of 12 May 2024, pages 100-200, call it 1-2-3.", "en"), (2, None, None)])
    assert [r["spans"] for r in pii.found(docs).collect()] == [[], []]
    assert pii.found(docs.limit(0)).count() == 0


def test_redacted(spark):
    docs = table_of(spark, [(1, "é a@b.c und 1.2.3.4!", "de"), (2, "none", "de"), (3, "+1 85 05 78 006 084 91 x", "fr")])
    out = pii.found(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {1: "é [email] und [ip]!", 2: "none", 3: "[phone] x"}


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "@" * 300_000, "a" * 300_000 + "@", "1 " * 150_000, "+1(" + "(" * 300_000, "0" * 300_000 + ".1.1.1"):
        assert pii.find(text) == [] or len(text) > len("1.1.1") and len(pii.find(text)) == 1


# --- phrases ---------------------------------------------------------------------------


def plain_phrases(rows, longest, least, top):
    grams, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                grams.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = {g: f for g, f in grams.items() if f >= least and len(g[1]) > 1}
    inside = set()
    for (lang, p), f in held.items():
        for k in range(2, len(p)):
            inside.update((lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * f >= 100 * grams[lang, p[i : i + k]])
    out = Counter()
    for lang in n:
        rows = []
        for (own, p), a in held.items():
            if own != lang or (own, p) in inside:
                continue
            cut = min((1000 * a * n[lang] // (grams[lang, p[:k]] * grams[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), a, grams[lang, p[: cut[1]]], grams[lang, p[cut[1] :]]))
        for rank, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank, p.decode(), a, l, r, n[lang], -s] += 1
    return out


@pytest.fixture(scope="module")
def phrased():
    rnd = random.Random(4)
    words = ["a", "b", "B", "É", "é", "c\xa0c", "x" * 300, "d", "."]
    rows = []
    for i in range(400):
        text = "".join(rnd.choice(words[: 3 + i % 7]) + rnd.choice([" ", "  ", "\t", ", ", "\n", " "]) for _ in range(rnd.randint(0, 40)))
        rows.append((i % 50, text, ["en", None, "fr", "und"][i % 4]))
    return rows + [(1, None, "en"), (None, "", "de"), (3, "a b " * 20_000, "es")]


@pytest.mark.parametrize("broadcast", [phrases.BROADCAST, 0])
def test_phrases_equal_brute_force(spark, phrased, broadcast):
    got = phrases.mined(table_of(spark, phrased), 5, 20, 30, broadcast)
    assert Counter(map(tuple, got.collect())) == plain_phrases(phrased, 5, 20, 30)


def test_phrases_equal_sql(spark, phrased):
    many = phrased[:-1] * 4  # the SQL copies a piece for each of its words
    got = phrases.mined(table_of(spark, many))
    assert Counter(map(tuple, got.collect())) == by_sql(phrases.SQL, many)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000L as f", "9000000000000000L as n", "array(3000000000000L, 4000000000000L) as begins", "array(2000000000L, 4000000000000L) as ends")
    cut = phrases._scored(row, 2).first()["cut"]
    assert cut["score"] == 1000 * 4000000000000 * 9000000000000000 // (3000000000000 * 2000000000)


def test_no_phrases_in_an_empty_table(spark):
    assert phrases.mined(table_of(spark, []).limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_phrases_stage_lists_and_keep_no_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "work_folder", lambda _: str(tmp_path))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in b}
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before, settings = shuffles(), [spark.conf.get(n) for n in names]
    docs = [(i, "a b c d e " * 20, "en") for i in range(30)]
    assert phrases.mined(table_of(spark, docs), 5, 20, 30, 0).collect()
    assert [spark.conf.get(n) for n in names] == settings
    ends = time.time() + 20
    while shuffles() - before and time.time() < ends:  # files go a little later
        time.sleep(0.2)
    assert not shuffles() - before
    # a row for each document, phrase or word, but none for each of the 3,000 places
    assert max(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) == len(docs)


def test_words_that_share_a_number_get_another_seed(spark, phrased, monkeypatch):
    number = phrases._number
    monkeypatch.setattr(phrases, "_number", lambda seed, lang, word: number(seed, lang, word) % 3 if seed < 2 else number(seed, lang, word))
    got = phrases.mined(table_of(spark, phrased[:-1]), 5, 20, 30)
    assert Counter(map(tuple, got.collect())) == plain_phrases(phrased[:-1], 5, 20, 30)


# --- alignment -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return align._pair(None, None)


def plain_alignment(pair, text):
    if not text:
        return (0, 0, 0, 0), "", Counter()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a, bytes_b = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
        return (0, 0, 0, 0), "", Counter()
    spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts)]).tolist(), np.cumsum(list(map(len, parts))).tolist()))
    of_a, of_b = spans(bytes_a), spans(bytes_b)
    links = Counter()
    j = 0
    for x, (s, e) in zip(a, of_a):
        while of_b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and of_b[k][0] < e:
            links[x, b[k]] += 1
            k += 1
    groups, i, j = [], 0, 0
    for end in sorted({e for _, e in of_a} & {e for _, e in of_b}):
        k = i + sum(e <= end for _, e in of_a[i : i + 400])
        l = j + sum(e <= end for _, e in of_b[j : j + 400])
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:l])))
        i, j = k, l
    return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


SIGNS = [
    " ", "  ", "\n", "\t", "a", "B", "é", "ß", "word", "Don't", "'s", "123", "4", "...", "!", "<s>", "</s>", "<|endoftext|>", "<unk>", "▁",
    "\xa0", "　", "日本", "한", "😀", "ﬁ", "é", "\x00", "\x85", "ǅ", "<0x41>", "İ", " x y z", "\r\n", "The quick",
]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(13)
    own = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    own += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 14))) for _ in range(1200)]
    return own + [own[0]] * 40 + [None, "", "word " * 50_000, "nospace" * 3000]


@pytest.mark.parametrize("broadcast", [align.BROADCAST, 0])
def test_alignment_equals_brute_force(spark, pair, texts, broadcast):
    rows = [(i % 1000, t, None) for i, t in enumerate(texts)]
    direct = [plain_alignment(pair, t) for t in texts]
    counts, highest = Counter(), Counter()
    for _, _, links in direct:
        counts.update(links)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter(
        (i % 1000, *sizes, sum(n for p, n in links.items() if counts[p] == highest[p[1]]), sum(n * counts[p] for p, n in links.items()), digest)
        for i, (sizes, digest, links) in enumerate(direct)
    )
    got = align.aligned(table_of(spark, rows).repartition(3), broadcast=broadcast)
    assert Counter(map(tuple, got.collect())) == want


def test_stretches_forgotten_or_cut_change_nothing(pair, texts, monkeypatch):
    some = [t for t in texts if t][:300] + ["word other " * 2000]
    shown = lambda: [(*r[:5], r[5].tolist(), r[6].tolist()) for r in align._text_rows(pair, some)]
    whole = shown()
    monkeypatch.setattr(align, "REMEMBERED", 50)
    monkeypatch.setattr(align, "AT_ONCE", 70)
    assert shown() == whole


def test_ranks_are_the_same_vocabulary(pair, spark):
    words = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    words = [" " + r["w"] for r in words.collect() if align._PLAIN.fullmatch(" " + r["w"])]
    assert pair.fast.encode_ordinary("".join(words)) == [i for e in pair.a.encode_batch(words, add_special_tokens=False) for i in e.ids]


def test_no_alignment_of_an_empty_table(spark):
    assert align.aligned(table_of(spark, []).limit(0)).count() == 0
    rows = align.aligned(table_of(spark, [(None, None, None), (1, "", None), (1, "", None)])).collect()
    assert Counter(map(tuple, rows)) == Counter({(None, 0, 0, 0, 0, 0, 0, ""): 1, (1, 0, 0, 0, 0, 0, 0, ""): 2})


@pytest.mark.parametrize("name", ["op11_pii", "op12_phrase_mining"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found, cursor = queries.QUERIES[name](spark, SF), db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, cursor.fetchall())


# --- hashes of words -------------------------------------------------------------------


def doubled(n, a="a", b="b"):
    """A word of n letters and its complement, built by doubling: no polynomial modulo 2**64 tells them apart."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [32, 64, 128, 1024, 8192])
def test_doubled_words_have_hashes_of_their_own(n):
    x, y = doubled(n)
    h, at = tokens.hashed(pa.array([x, y, x.upper(), f"{y} {x}", None]))
    assert at.tolist() == [0, 1, 2, 3, 5, 5]
    assert h[0] != h[1] and h[0] == h[2] == h[4] and h[1] == h[3]


def test_operators_tell_doubled_words_apart(spark):
    x, y = doubled(2048)
    docs = spark.createDataFrame([(0, x), (1, y), (2, f"{x} one two three four five"), (3, f"{y} one two three four five")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classed(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    scored = lm.scored(docs, F.col("doc_id").isin(1, 3)).collect()
    assert {r["doc_id"]: r["n_known"] for r in scored}[1] == 1  # its end, but not its word
    ids = packing.Ids(public_tokenizers.path(packing.VOCABULARY))
    found, at = ids.of(pa.array([x, y]))
    want = [ids.model.encode(w, add_special_tokens=False).ids for w in (x, y)]
    assert [found[at[i] : at[i + 1]].tolist() for i in range(2)] == want
