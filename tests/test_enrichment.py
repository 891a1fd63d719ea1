import json
import math

import pandas as pd
from pyspark.sql import functions as F

from gazette.operators import enrichment as E
from gazette.operators import logs as L
from gazette.operators import reports as P
from gazette.schemas import Settings


def test_commercial_criteria(evaluate):
    raw = ["Promotion : 20 €", "Soldes jusqu'au 3 mai", "un VPN", "promoteur immobilier", "-20% sur l'abonnement", None]
    hits = evaluate(E.commercial_hits, raw)
    assert hits == [["promotion", "price"], ["promotion", "time"], ["subscription"], [], ["price", "subscription"], []]
    assert evaluate(lambda c: E.is_commercial(E.commercial_hits(c)), raw) == [True, True, False, False, True, False]


def test_significance(evaluate):
    assert evaluate(E.significance, [None, 0.0, 0.75, 1.0], "double") == [10.0, 10.0, 2.5, 0.0]


def test_summary_and_tag_follow_tfidf(spark):
    rows = [(1, "Le chat dort. Le robot quantique calcule vite! Le chat."), (2, "Le chat mange. Le chat dort."), (3, "...")]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r["id"]: r["summary"] for r in E.lead_summary(docs, 1).collect()} == {
        1: "Le robot quantique calcule vite!", 2: "Le chat mange."}
    two = {r["id"]: r["summary"] for r in E.lead_summary(docs, 2).collect()}
    assert two[1] == "Le chat dort. Le robot quantique calcule vite!"
    tags = {r["id"]: r["tag"] for r in E.top_tag(docs).collect()}
    weight = lambda tf, df: tf * round(1000 * math.log(4 / (df + 1)))
    best = max([("le", weight(3, 2)), ("chat", weight(2, 2)), ("calcule", weight(1, 1)), ("quantique", weight(1, 1))], key=lambda p: p[1])
    assert tags == {1: best[0].capitalize(), 2: "Mange" if weight(1, 1) > weight(2, 2) else "Chat"}


def test_prompt(spark):
    ledger = spark.createDataFrame([(1, "un"), (2, None), (3, "trois")], "ingest_ord long, title string")
    history = E.recent_titles(ledger, 2).first()["history"]
    assert history == "1. Sans titre\n2. trois"
    rows = spark.createDataFrame([("t", "c" * 2000, history), ("t", None, None)], "t string, c string, h string")
    first, second = [r[0] for r in rows.select(E.build_prompt(F.col("t"), F.col("c"), F.col("h"))).collect()]
    assert "CONTENU: " + "c" * 1500 + "\n" in first and "c" * 1501 not in first and history in first
    assert "Articles précédents" not in second
    budget = E.prompt_budget(spark.createDataFrame([("f", "a b c"), ("f", "d")], "feed string, prompt string"), "feed")
    got = budget.first().asDict()
    assert round(got.pop("p90_words"), 9) == 2.8
    assert got == {"feed": "f", "prompts": 2, "chars": 6, "n_words": 4, "median_words": 2.0}


def test_budget_measures_earlier_titles_once(spark):
    """Sizes of heads and of the common rest add up to those of whole prompts, and rows don't carry the rest."""
    rows = [("f", "Été « un »", "Le chat dort.\nIl ΣΟΣ" * 200), ("f", None, None), ("g", "t", "-"), ("g", "", "fin Σ")]
    articles = spark.createDataFrame(rows, "feed string, title string, text string")
    for titles in (["un", None, "trois Σ"], []):
        ledger = spark.createDataFrame(list(enumerate(titles)), "ingest_ord long, title string")
        history = E.recent_titles(ledger, 9)
        whole = articles.select("feed", E.build_prompt(F.col("title"), F.col("text"), history.scalar()).alias("prompt"))
        heads = articles.select("feed", E.prompt_head(F.col("title"), F.col("text")).alias("prompt"))
        rest = history.select(E.prompt_size(E.prompt_rest(F.col("history")))).scalar()
        found = E.prompt_budget(heads, "feed", rest)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, E.prompt_budget(whole, "feed").collect()))
        assert found.schema == E.prompt_budget(whole, "feed").schema


def test_only_rare_terms_go_to_their_weights(spark, plan_of):
    """The same weights however many are sent; texts are not shuffled, only what is summed of them."""
    rows = [(i, f"Le chat {i % 7} dort ici. Le robot r{i} calcule! Le chat x{i % 20} le.") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    whole = sorted(map(tuple, E.weighed_terms(docs).collect()))
    assert len(whole) == 60 * 13
    for broadcast in (0, 150, 500, 2000):
        for dealt in (False, True):
            assert sorted(map(tuple, E.weighed_terms(docs, broadcast, dealt).collect())) == whole
    assert "Exchange hashpartitioning" not in plan_of(E.weighed_terms(docs, dealt=False))
    terms = E.weighed_terms(docs, 500)
    assert E.lead_summary(docs, 1, terms).collect() and sorted(E.lead_summary(docs, 1, terms).collect()) == sorted(E.lead_summary(docs, 1).collect())


def test_failing_rows_get_the_failure_defaults(spark):
    def scorer(batch: pd.DataFrame) -> pd.Series:
        if (batch["title"] == "bad").any():
            raise RuntimeError("no answer")
        return pd.Series([json.dumps({"summary": t, "tags": ["T"]}) if t != "text" else "texte" for t in batch["title"]])

    rows = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "text")], "link string, title string")
    got = {r["link"]: r for r in E.enrich(rows, scorer, ("title",)).collect()}
    assert got["a"]["parse_ok"] and got["a"]["summary"] == "ok" and got["a"]["failure"] is None
    bad = got["b"]
    assert (bad["parse_ok"], bad["failure"], bad["significanceScore"], bad["isDouble"], bad["isCommercial"], bad["tags"]) == (
        False, "no answer", 5.0, False, False, [])
    assert bad["summary"] == "Erreur lors de l'analyse"
    assert not got["c"]["parse_ok"] and got["c"]["failure"] is None


def test_only_scorer_inputs_cross_to_python(spark, plan_of):
    rows = spark.createDataFrame([("a", "t", "big")], "link string, title string, body string")
    plan = plan_of(E.enrich(rows, lambda b: b["title"], ("title",)))
    assert "MapInPandas" in plan and "body" not in plan.split("MapInPandas")[1].split("\n")[0]


def test_native_operators_stay_in_the_jvm(spark, plan_of):
    from gazette.functions import dates, entities, text

    rows = spark.createDataFrame([("a",)], "x string")
    plan = plan_of(rows.select(
        text.clean_content(rows.x), text.chunk_words(rows.x), entities.unescape_text(rows.x), dates.parse_feed_date(rows.x)))
    assert "Python" not in plan and "Pandas" not in plan


def test_reports(spark):
    rows = [("s", "u", (True, False, 4.0, ["A"])), ("s", "u", (False, False, 2.0, ["B"])), ("t", "v", (False, True, None, []))]
    kind = "struct<isDouble: boolean, isCommercial: boolean, significanceScore: double, tags: array<string>>"
    articles = spark.createDataFrame(rows, f"source string, url string, analysis {kind}")
    got = {r["source"]: r for r in P.source_summary(articles).collect()}
    assert (got["s"]["articles"], got["s"]["links"], got["s"]["doubles"], got["s"]["double_share"], got["s"]["mean_score"]) == (2, 1, 1, 0.5, 3.0)
    assert got["t"]["commercial_share"] == 1.0 and got["t"]["mean_score"] is None
    levels = {(r["source"], r["tag"], r["level"]): r["articles"] for r in P.tag_rollup(articles).collect()}
    assert levels[None, None, 3] == 3 and levels["s", None, 1] == 2 and levels["t", None, 0] == 1


def test_interaction_log(spark, tmp_path):
    import datetime

    pairs = spark.createDataFrame([("p", "r"), ("q", None)], "prompt string, response string")
    day = datetime.date(2024, 5, 6)
    assert L.interaction_log(pairs, day, False).count() == 0
    log = L.interaction_log(pairs, day, True)
    entry = log.where("prompt = 'p'").first()
    assert "PROMPT:\np\n" in entry["entry"] and (entry["prompt_chars"], entry["response_chars"]) == (1, 1)
    path = str(tmp_path / "log")
    later = datetime.date(2024, 5, 7)
    for _ in range(2):  # a repeated run overwrites what it wrote
        L.write_log(log, path, day, "a")
        L.write_log(L.interaction_log(pairs, later, True), path, later, "b")
    written = L.read_log(spark, path).select("log_date", "run", "prompt")
    assert sorted(map(tuple, written.collect())) == [(day, "a", "p"), (day, "a", "q"), (later, "b", "p"), (later, "b", "q")]
    assert L.purge_logs(spark, path) == 2 and L.purge_logs(spark, path) == 0
    assert Settings().log_interactions is False


def test_short_words_can_be_tags(spark):
    documents = spark.createDataFrame([(1, "F1 F1 IA"), (2, "IA")], "id long, text string")
    assert {r["id"]: r["tag"] for r in E.top_tag(documents).collect()} == {1: "F1", 2: "Ia"}


def test_terms_are_weighed_alike_on_both_ways(spark, plan_of):
    texts = ["Un deux deux. Trois un!\nDeux", "un quatre", None, "", "deux. deux? trois trois trois"]
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    few, many = E.weighed_terms(documents), E.weighed_terms(documents, broadcast=0)
    rows = lambda df: sorted(map(tuple, df.select("id", "pos", "term", "idf").collect()))
    assert rows(few) == rows(many) and len(rows(few)) == 13
    # terms of a document stay where the document was dealt: one exchange in all
    tags = plan_of(E.top_tag(documents, few))
    assert tags.count("Exchange hashpartitioning") == 1 and "hashpartitioning(id" in tags
    assert sorted(map(tuple, E.top_tag(documents, many).collect())) == sorted(map(tuple, E.top_tag(documents, few).collect()))


def test_a_wrong_number_of_answers_is_a_failure(spark):
    rows = spark.createDataFrame([("a", "t"), ("b", "u")], "link string, title string").coalesce(1)
    got = E.enrich(rows, lambda batch: batch["title"].iloc[:1] if len(batch) > 1 else batch["title"], ("title",)).collect()
    assert {r["link"]: (r["answer"], r["failure"]) for r in got} == {"a": ("t", None), "b": ("u", None)}


def test_native_answers_need_no_python(spark, plan_of):
    row = spark.createDataFrame(
        [("l", True, "x", 'a "b"', False, 2.5, "s\n", "T"), ("m", False, None, None, True, 10.0, None, None)],
        "link string, is_double boolean, similar_article string, similarity_reason string, is_commercial boolean, significance double, summary string, tag string",
    )
    scored = E.enrich(row)
    assert "MapInPandas" not in plan_of(scored)
    got = {r["link"]: r for r in scored.collect()}
    assert (got["l"]["isDouble"], got["l"]["similarityReason"], got["l"]["tags"], got["l"]["parse_ok"]) == (True, 'a "b"', ["T"], True)
    assert (got["m"]["similarArticle"], got["m"]["summary"], got["m"]["tags"], got["m"]["significanceScore"]) == (None, "", [], 10.0)


def test_links_are_counted_from_the_sketches_of_runs(spark, tmp_path):
    path = str(tmp_path / "sketches")
    assert P.link_counts(P.read_link_sketches(spark, path)).count() == 0
    rows = spark.range(30_000).selectExpr("if(id < 20000, 'a', 'b') as source", "concat('l', id) as url")
    for run, low in (("r0", 0), ("r1", 8_000), ("r1", 8_000)):
        P.write_link_sketches(rows.where(F.col("url").substr(2, 9).cast("int").between(low, low + 15_999)), path, run)
    got = {r["source"]: r["links"] for r in P.link_counts(P.read_link_sketches(spark, path)).collect()}
    # runs share half of their links; what is written does not grow with them
    assert abs(got["a"] - 20_000) < 1_200 and abs(got["b"] - 4_000) < 240
    assert P.read_link_sketches(spark, path).agg(F.max(F.octet_length("links"))).first()[0] < 5_000
