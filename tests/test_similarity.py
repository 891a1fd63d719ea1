import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gazette.common as common
from gazette.common import Staged, skew_join, stage
from gazette.functions.text import words
from gazette.operators import similarity as M


def jaccard(a, b):
    return len(a & b) / len(a | b)


def earliest(sets, threshold):
    """All-pairs answer: id -> (earliest similar earlier id, similarity)."""
    out = {}
    for i, s in sets:
        for j, t in sets:
            if j < i and s and t and jaccard(s, t) >= threshold:
                if i not in out or j < out[i][0]:
                    out[i] = (j, round(jaccard(s, t), 9))
    return out


def titles(seed, n):
    rng = random.Random(seed)
    common_words = ["le", "la", "de", "prix", "test"]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # copies of one title in changing order
            w = "gros titre copié partout".split()
            rng.shuffle(w)
        elif kind < 0.6:  # one family with a changing word
            w = "le grand test complet de la nouvelle console".split() + [f"x{rng.randint(0, 40)}"]
        elif kind < 0.75:  # shares words but is not similar
            w = common_words + [f"y{rng.randint(0, 200)}" for _ in range(6)]
        else:
            w = [rng.choice(common_words + [f"z{k}" for k in range(30)]) for _ in range(rng.randint(0, 40))]
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


def compare(found, expected):
    got = {r["id"]: (r["match_id"], round(r["similarity"], 9)) for r in found.collect()}
    assert got == expected


@pytest.mark.parametrize("hot_rows", [None, 3])
@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_titles_equal_all_pairs(spark, monkeypatch, threshold, hot_rows):
    """Also with every key above three rows salted."""
    if hot_rows:
        monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    data = titles(int(threshold * 10), 250)
    frame = spark.createDataFrame(data, "id long, title string")
    expected = earliest([(i, set(t.lower().split())) for i, t in data], threshold)
    assert len(expected) > 50
    compare(M.similar_titles(frame, threshold), expected)


def test_history_is_compared_with_but_not_answered(spark):
    data = titles(11, 200)
    frame = spark.createDataFrame(data, "id long, title string")
    expected = earliest([(i, set(t.lower().split())) for i, t in data], 0.6)
    compare(M.similar_titles(frame, 0.6, since=150), {i: m for i, m in expected.items() if i >= 150})


def test_leader_miss_goes_on_to_later_members(spark):
    """Keys shared by all: the leader is similar to nobody, so every pair must be tried."""
    sets = [(0, {1, 2}), (1, {3, 4, 5, 6}), (2, {3, 4, 5, 7}), (3, {3, 4, 5, 6, 7}), (4, {9})]
    features = stage(spark.createDataFrame([(i, sorted(s)) for i, s in sets], "id long, feature array<long>"), "f")
    keyed = stage(features.df.select(F.lit(1).alias("key"), F.lit(1).alias("seeks"), "id"), "k")
    compare(M.earliest_match(keyed, features.df, M.jaccard, 0.5), earliest(sets, 0.5))


def test_flags_name_the_original(spark):
    rows = [(1, "Nouveau test de la console"), (2, "console : nouveau TEST de la !"), (3, "autre"), (4, None)]
    articles = spark.createDataFrame(rows, "id long, title string")
    got = {r["id"]: r for r in M.duplicate_flags(articles, M.similar_titles(articles)).collect()}
    assert got[2]["is_double"] and got[2]["similar_article"] == rows[0][1] and got[2]["similarity"] == 1.0
    assert got[2]["similarity_reason"] == "console de la nouveau test"
    assert not got[1]["is_double"] and not got[3]["is_double"] and not got[4]["is_double"]
    assert got[3]["similarity_reason"] is None


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        if i % 3 == 0 or i < 10:
            text = [f"m{rng.randint(0, 3000)}" for _ in range(120)]
        else:
            text = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = f"n{rng.randint(0, 3000)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "id long, text string")

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {i: grams(t) for i, t in rows}
    found = {r["id"]: (r["match_id"], r["similarity"]) for r in M.near_duplicates(frame).collect()}
    exact = earliest(list(sets.items()), 0.7)
    assert len(exact) > 30 and set(found) == set(exact)
    for i, (match, similarity) in found.items():
        assert abs(jaccard(sets[i], sets[match]) - similarity) < 1e-9
        assert match == min(j for j in sets if j < i and jaccard(sets[i], sets[j]) >= 0.7 - 1e-12)


def test_short_texts_are_one_shingle(evaluate):
    got = evaluate(lambda c: M.shingles(words(c)), ["A b c d", "a b", "a", "", "a a a a"])
    assert [sorted(g) for g in got] == [["a b c", "b c d"], ["a b"], ["a"], [""], ["a a a"]]


def test_unrelated_vectors_change_no_answer(spark):
    rng = np.random.default_rng(5)
    pairs = rng.normal(size=(40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([pairs, pairs + rng.normal(size=pairs.shape) * 0.3]))]
    others = [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 64)))]
    found = []
    for data in (rows, rows + others):
        frame = spark.createDataFrame(data, "id long, embedding array<double>")
        found.append({(r["id"], r["match_id"]) for r in M.similar_vectors(frame, 0.8).collect() if r["id"] < 1000})
    assert found[0] == found[1] and len(found[0]) > 30


@pytest.mark.parametrize("hot_rows", [None, 5])
@pytest.mark.parametrize("threshold,pivots", [(0.35, None), (0.35, 1), (0.8, 12), (0.97, 40), (-0.5, 3)])
def test_vectors_equal_all_pairs(spark, monkeypatch, threshold, pivots, hot_rows):
    if hot_rows:
        monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    # a third near one centre, exact and scaled copies, and vectors far from all others
    data = [centres[0 if i % 3 == 0 else i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.3, 1.5]) for i in range(150)]
    data += [data[7], data[7] * 2, data[20] * 1e-8] + list(rng.normal(size=(20, 12)))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    unit = np.array(data) / np.linalg.norm(data, axis=1)[:, None]
    cosines = unit @ unit.T
    expected = {i: int(np.flatnonzero(cosines[i, :i] >= threshold)[0]) for i in range(len(data)) if (cosines[i, :i] >= threshold).any()}
    odd = [(500, None), (501, []), (502, [0.0] * 12), (503, [None] + [1.0] * 11), (504, [float("nan")] * 12), (505, [float("inf")] * 12), (506, [1.0, 0.0]), (507, [2.0, 0.0]), (508, [3.0])]
    frame = spark.createDataFrame(rows + odd, "id long, embedding array<double>")
    found = {r["id"]: (r["match_id"], r["similarity"]) for r in M.similar_vectors(frame, threshold, pivots).collect()}
    assert found.pop(507) == (506, 1.0)
    assert {i: m for i, (m, _) in found.items()} == expected
    assert all(abs(c - cosines[i, m]) < 1e-9 for i, (m, c) in found.items() if c != 1.0)


def test_no_vectors(spark):
    assert M.similar_vectors(spark.createDataFrame([], "id long, embedding array<float>")).collect() == []


def test_far_cells_share_no_bucket(spark):
    """At a high threshold vectors only stand in buckets of cells near them."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    data = [c + rng.normal(size=32) * 0.02 for c in centres for _ in range(20)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(data)]
    keys = M.pivot_keys(spark.createDataFrame(rows, "id long, feature array<double>"), 0.95, 400, 60).count()
    assert keys < 400 * 12


def test_similar_vectors(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in base[i % 10]]) for i in range(40)] + [(40, base[3]), (41, base[3])]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {r["id"]: r["match_id"] for r in M.similar_vectors(frame, 0.95).collect()}
    assert all(got[i] == i % 10 for i in range(10, 40)) and got[40] == 3 and got[41] == 3
    assert not set(got) & set(range(10))


def test_topic_groups(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, topic_id string")
    assert [tuple(r) for r in M.topic_groups(rows).collect()] == [("a", 1, 2)]


@pytest.mark.parametrize("hot_rows", [10**9, 5])
def test_skew_join_is_an_inner_join(spark, hot_rows):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, key string")
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("absent", 4)], "key string, v int")
    joined = skew_join(facts, dim, "key", spread="id", rows=300, hot_rows=hot_rows)
    plain = facts.join(dim, "key")
    assert sorted(map(tuple, joined.select("id", "key", "v").collect())) == sorted(map(tuple, plain.select("id", "key", "v").collect()))


def test_hot_key_is_spread_over_tasks(spark):
    facts = spark.range(1000).select("id", F.lit("hot").alias("key"))
    dim = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(facts, dim, "key", spread="id", rows=1000, hot_rows=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 700


def test_staged_rows(spark):
    staged = stage(spark.range(7), "n")
    assert isinstance(staged, Staged) and staged.rows == 7 and staged.df.count() == 7
    assert stage(spark.range(0), "n").rows == 0
    assert stage(spark.range(4), "n", F.sum("id")).rows == 6


def test_words(evaluate):
    assert evaluate(words, ["L'été, 2024 !", "", None, "--"]) == [["l", "été", "2024"], [], [], []]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_without_a_key_are_spread_and_match_nothing(spark, how):
    facts = spark.range(600).selectExpr("if(id < 500, null, 'k') as key", "id")
    dim = spark.createDataFrame([("k", 1), (None, 2)], "key string, v int")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(facts, dim, "key", spread="id", how=how, hot_rows=50)
        got = joined.withColumn("at", F.spark_partition_id()).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    without = [r for r in got if r["key"] is None]
    assert len(got) == (600 if how == "left" else 100) and all(r["v"] is None for r in without)
    assert sum(r["v"] == 1 for r in got) == 100 and (how == "inner" or len({r["at"] for r in without}) > 1)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_texts_in_rounds_equal_all_pairs(spark, monkeypatch, rounds):
    """Families around the threshold, so that leaders and the first possible members are missed, with few and many rounds."""
    monkeypatch.setattr(M, "SKETCH_ROUNDS", rounds)
    rng = random.Random(8)
    rows = []
    for i in range(90):
        text = [f"m{k}" for k in range(60)] if i < 2 else rows[rng.randrange(max(0, i - 20), i)][1].split()
        for _ in range(rng.randint(2, 6)):
            text[rng.randrange(len(text))] = f"n{rng.randint(0, 60)}"
        rows.append((i, " ".join(text)))
    grams = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    compare(M.near_duplicates(spark.createDataFrame(rows, "id long, text string")), earliest(list(grams.items()), 0.7))


def test_unshared_elements_open_no_bucket(spark):
    """Sets whose rare end is their own have no keys, and the others are kept without what no set shares."""
    sets = [(0, list(range(100))), (1, list(range(95)) + [900]), (2, list(range(1000, 1090)) + list(range(10))), (3, [])]
    parts = M.shared_parts(spark.createDataFrame(sets, "id long, feature array<long>"), 0.7)
    got = {r["id"]: (r["alone"], r["feature"]["n"], len(r["feature"]["shared"])) for r in parts.df.collect()}
    assert got == {0: (5, 100, 95), 1: (1, 96, 95)}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_sketches_never_hide_a_similar_set(spark, threshold):
    rng = random.Random(int(threshold * 10))
    base = [rng.getrandbits(62) - 2**61 for _ in range(300)]
    sets = [(i, rng.sample(base, rng.randint(200, 300))) for i in range(60)]
    parts = M.shared_parts(spark.createDataFrame(sets, "id long, feature array<long>"), threshold).df
    a, b = parts.alias("a"), parts.alias("b")
    hidden = a.join(b, F.col("a.id") < F.col("b.id")).where(M.shared_jaccard(F.col("a.feature"), F.col("b.feature")) >= threshold)
    assert hidden.where(~M.may_be_similar(threshold)(F.col("a.sketch"), F.col("b.sketch"))).count() == 0 and (threshold > 0.8 or hidden.count() > 10)


@pytest.mark.parametrize("threshold,sent", [(0.2, 30), (0.9, 4), (0.9, 60), (0.2, 1000)])
def test_scanned_vectors_equal_all_pairs(spark, monkeypatch, threshold, sent):
    """Partners among the first vectors, among all others, and by pivots where many have none early."""
    monkeypatch.setattr(M, "SCAN_BYTES", sent * 8 * 12)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 12))
    data = [centres[i % 9] + rng.normal(size=12) * rng.choice([0.1, 2.0]) for i in range(160)]
    unit = np.array(data) / np.linalg.norm(data, axis=1)[:, None]
    cosines = unit @ unit.T
    expected = {i: int(np.flatnonzero(cosines[i, :i] >= threshold)[0]) for i in range(160) if (cosines[i, :i] >= threshold).any()}
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(300, [1.0, 0.0]), (301, [1.0, 0.1]), (302, None)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    used = []
    monkeypatch.setattr(M, "pivot_keys", lambda *a, keys=M.pivot_keys: used.append(1) or keys(*a))
    found = {r["id"]: r["match_id"] for r in M.similar_vectors(frame, threshold).collect()}
    assert found.pop(301) == 300 and found == expected
    assert bool(used) == (sent == 4)


def test_repeated_ids_are_answered_as_often_as_they_come(spark):
    """A row that copies an earlier one doesn't drop the other text of its id, and twins double no answer."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4, 16)).tolist()
    near = (np.array(v[1]) * 1.01 + 0.01).tolist()
    frame = spark.createDataFrame([(1, v[0]), (2, v[1]), (3, v[0]), (3, near), (4, v[2]), (4, v[2])], "id long, embedding array<double>")
    found = sorted((r["id"], r["match_id"]) for r in M.similar_vectors(frame, 0.9).collect())
    assert found == [(3, 1), (3, 1)]
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    texts = spark.createDataFrame([(1, a), (2, b), (3, a), (3, c), (4, c + " neu"), (5, b), (5, b)], "id long, text string")
    assert sorted((r["id"], r["match_id"]) for r in M.near_duplicates(texts).collect() if r["id"] in (3, 5)) == [(3, 1), (5, 2), (5, 2)]
