"""The three whole runs: intake, retention and purge."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.common import stage
from gazette.functions.text import clean_content
from gazette.operators import content as C
from gazette.operators import enrichment as E
from gazette.operators import logs as L
from gazette.operators import records as R
from gazette.operators import reports as P
from gazette.operators import retention as N
from gazette.operators import selection as S
from gazette.operators.contents import combined_matches
from gazette.operators.similarity import duplicate_flags, near_duplicates, similar_titles
from gazette.schemas import Settings
from gazette.sources.feeds import complete_entries
from gazette.sources.ledger import LedgerStore
from gazette.sources.pages import keep_images, read_image_cache


def select_articles(
    entries: DataFrame, registry: DataFrame, ledger: DataFrame, settings: Settings
) -> DataFrame:
    """First k per feed, once per link, not in the ledger: everything that shrinks the input
    runs before any text work."""
    kept = S.first_k_per_feed(entries, settings.max_articles_per_feed)
    named = S.name_feeds(complete_entries(kept), registry)
    return S.new_articles(S.dedup_batch(named), ledger)


def assemble_article(
    articles: DataFrame, history: DataFrame, settings: Settings, store: LedgerStore | None = None, run: str | None = None
) -> DataFrame:
    """Everything a scorer is given: cleaned text, match with an earlier article by title or text, commercial
    criteria, novelty, summary and tag. ``articles`` and ``history`` have (id, title, content);
    history ids come before article ids, and without its ``content`` only titles are compared. With a ``store`` that keeps
    keys of titles or texts, history is looked up there, and only articles are compared with each other."""
    cleaned = stage(
        articles.withColumn("text", clean_content(F.col("content"))), "articles"
    ).df
    first_new = cleaned.agg(F.min("id")).first()[0]
    named = cleaned.select("id", "title").unionByName(history.select("id", "title"))
    if store is not None and store.title_jaccard == settings.min_title_jaccard:
        titles = cleaned.select("id", "title")
        stored = stage(store.earlier_titles(titles, run), "earlier").df
        matches = _first_stored(stored, similar_titles(titles, settings.min_title_jaccard))
        named = cleaned.select("id", "title").unionByName(_originals(stored))
    else:
        matches = similar_titles(named, settings.min_title_jaccard, since=first_new)
    if settings.min_content_jaccard is not None:
        texts = cleaned.select("id", "text")
        if store is not None and store.content_jaccard == settings.min_content_jaccard:
            stored = stage(store.earlier_contents(texts, run), "earlier-texts").df
            by_text = _first_stored(stored, near_duplicates(texts, settings.min_content_jaccard))
            named = named.unionByName(_originals(stored))
        elif "content" in history.columns:
            past = history.select("id", F.col("content").alias("text"))
            by_text = near_duplicates(texts.unionByName(past), settings.min_content_jaccard, since=first_new)
            named = named.unionByName(history.select("id", "title").join(by_text.select(F.col("match_id").alias("id")), "id", "left_semi"))
        else:
            by_text = near_duplicates(texts, settings.min_content_jaccard)
        matches = combined_matches(matches, by_text, settings.title_weight, settings.content_weight)
    # an original may be named by its title and by its text
    flagged = duplicate_flags(cleaned, matches, named.dropDuplicates(["id"]))
    texts = cleaned.select("id", "text")
    terms = E.weighed_terms(texts)
    summary, tag = E.lead_summary(texts, terms=terms), E.top_tag(texts, terms)
    joined = flagged.join(summary, "id", "left").join(tag, "id", "left")
    hits = E.commercial_hits(F.concat_ws(" ", "title", "text"))
    return joined.withColumn("commercial_hits", hits).withColumns(
        {
            "is_commercial": E.is_commercial(F.col("commercial_hits")),
            "significance": E.significance(F.col("similarity")),
        }
    )


def _first_stored(stored: DataFrame, among: DataFrame) -> DataFrame:
    """Matches with earlier runs, and those among the articles of a run where there is none."""
    return among.join(stored, "id", "left_anti").unionByName(stored.drop("similar_article"))


def _originals(stored: DataFrame) -> DataFrame:
    """(id, title) of the matched earlier articles."""
    return stored.select(F.col("match_id").alias("id"), F.col("similar_article").alias("title")).distinct()


def article_pipeline(
    articles: DataFrame,
    history: DataFrame,
    settings: Settings = Settings(),
    scorer: E.Scorer | None = None,
    inputs: tuple[str, ...] = E.CRITERIA,
    prompts: bool = False,
    store: LedgerStore | None = None,
    run: str | None = None,
) -> DataFrame:
    """Cleaned and scored articles with the analysis flattened next to them.

    A scorer is given the columns ``inputs``, which may name ``prompt``: with ``prompts`` the text sent to a
    model is built of the article and the titles of the history, as many as ``prompt_history`` says. ``store`` and ``run``
    as in ``assemble_article``: the store the history comes from, and the run it does not see.
    """
    assembled = assemble_article(articles, history, settings, store, run)
    if prompts:
        past = E.recent_titles(history.withColumnRenamed("id", "ingest_ord"), settings.prompt_history).scalar()
        assembled = assembled.withColumn("prompt", E.build_prompt(F.col("title"), F.col("text"), past, settings))
    assembled = stage(assembled, "assembled").df
    scored = E.enrich(assembled, scorer, inputs)
    keep = [c for c in articles.columns if c != "content"] + ["text", "commercial_hits"] + ["prompt"] * prompts
    return assembled.select(*keep).join(scored, "link")


@dataclass(frozen=True)
class Steps:
    """What a run may be given beside its tables.

    ``scorer`` and ``inputs`` as in ``article_pipeline``; ``deliver`` maps page records to (link, status,
    page_id), without it every record counts as delivered under the md5 of its link; ``rewrites``
    (image_url, new_url) are re-hosted pictures of ``rewritten`` sources; ``parent`` is the page store the records go to;
    ``log_path`` is where prompts and answers are logged while the settings say so; ``image_path`` is the cache of
    pictures, which serves articles without one and gets those that the run finds; ``sketch_path`` gets a sketch of
    the run's links per source (``operators.reports``).
    """

    scorer: E.Scorer | None = None
    inputs: tuple[str, ...] = E.CRITERIA
    deliver: Callable[[DataFrame], DataFrame] | None = None
    rewrites: DataFrame | None = None
    rewritten: tuple[str, ...] = ("JVC",)
    parent: str | None = None
    log_path: str | None = None
    image_path: str | None = None
    sketch_path: str | None = None


def run_intake(
    spark: SparkSession,
    entries: DataFrame,
    registry: DataFrame,
    pages: DataFrame,
    store: LedgerStore,
    run_ts: datetime.datetime,
    settings: Settings = Settings(),
    run: str | None = None,
    steps: Steps = Steps(),
) -> DataFrame:
    """One intake run: select, fetch text, score, record, append to the ledger, retain.

    Returns the page records. Repeating the latest run under its name gives the same ledger, log and
    archive. A run without new articles compares nothing, and only retains.
    """
    run = store.new_run() if run is None else run
    before = store.read(besides=run)
    selected = stage(select_articles(entries, registry, before, settings), "selected")
    chosen = selected.df
    cached = None
    if steps.image_path is not None:
        cached = read_image_cache(spark, steps.image_path, chosen, besides=run)
    if selected.rows:
        wanted = pages.join(chosen.select(F.col("link").alias("url")), "url", "left_semi")
        articles = _articles(chosen, wanted, store.last_ord(run), steps, cached)
    else:
        articles = _articles(chosen, pages.limit(0), F.lit(-1), steps, cached)
    articles = stage(articles, "chosen").df
    if steps.image_path is not None:
        keep_images(articles, steps.image_path, run_ts, run)
    logged = settings.log_interactions and steps.log_path is not None
    if selected.rows:
        history = before.select(F.col("ingest_ord").alias("id"), "title", "content")
        prompts = logged or "prompt" in steps.inputs
        scored = article_pipeline(articles, history, settings, steps.scorer, steps.inputs, prompts, store, run)
        scored = stage(scored, "answers").df
        answered = articles.join(scored.select("link", F.col("answer").alias("analysis")), "link")
    else:
        answered = articles.withColumn("analysis", F.lit(None).cast("string"))
    answered = stage(answered, "scored").df
    if logged and selected.rows:
        asked = scored.select("link", "prompt", F.col("answer").alias("response"))
        L.write_log(L.interaction_log(asked, run_ts.date(), True), steps.log_path, run_ts.date(), run)
    records = stage(R.page_record(answered, settings, steps.parent), "records").df
    if steps.deliver is None:
        outcome = records.select("link", F.lit(200).alias("status"), F.md5("link").alias("page_id"))
    else:
        outcome = steps.deliver(records)
    # a later answer about the same page must see the numbers given here
    rows = stage(
        R.ledger_rows(answered.join(outcome, "link"), run_ts).drop("ingest_ord")
        .join(articles.select(F.col("link").alias("url"), F.col("id").alias("ingest_ord")), "url"),
        "rows",
    ).df
    store.append(rows, run)
    if steps.sketch_path is not None:
        P.write_link_sketches(rows, steps.sketch_path, run)
    apply_retention(before.unionByName(rows.select(*before.columns)), store, run, settings)
    return records


def _articles(chosen: DataFrame, pages: DataFrame, top: Column, steps: Steps, cached: DataFrame | None) -> DataFrame:
    """Chosen entries with the text of their pages and the picture that goes on, numbered after ``top``."""
    fetched = C.attach_content(chosen, C.article_content(pages)).select(
        "link", "title", "content", "published_date",
        F.coalesce("page_image", "image_url").alias("image_url"),
        F.col("feed_name").alias("source"),
    )
    if "is_site_enclosure" in chosen.columns:
        fetched = C.override_image(fetched.withColumnRenamed("link", "url"), chosen, spread="url").withColumnRenamed("url", "link")
    if cached is not None:
        known = cached.withColumnRenamed("image_url", "_cached")
        fetched = fetched.join(known, "link", "left").withColumn("image_url", F.coalesce("image_url", "_cached")).drop("_cached")
    if steps.rewrites is not None:
        fetched = C.rewrite_image(fetched, steps.rewrites, steps.rewritten)
    return fetched.withColumn("id", top + 1 + F.monotonically_increasing_id())


def apply_retention(ledger: DataFrame, store: LedgerStore, run: str, settings: Settings) -> DataFrame:
    """Trim the ledger including this run's rows; returns the remote pages to archive, which
    the store keeps as well. What is written is the removed rows' numbers."""
    _, oldest = N.retain(ledger, settings.auto_clean_threshold, settings.clean_remove_count)
    removed = stage(oldest.select("ingest_ord", "page_id", "url", "title"), "removed").df
    archive = N.archive_set(removed)
    store.keep_archive(archive, run)
    store.remove(removed, run)
    return archive


def run_purge(
    listing: DataFrame, outcomes: DataFrame, store: LedgerStore, logs: DataFrame, log_path: str | None = None
) -> DataFrame:
    """Remove archived pages from the ledger, delete the days of the log, and report.

    ``outcomes`` has (page_id, status) of the archive requests for ``listing``.
    """
    ledger = store.read()
    joined = stage(listing.join(outcomes, "page_id", "left"), "outcomes").df
    report = stage(N.purge_report(joined, ledger, logs), "report").df
    gone = joined.where("status = 200").select("url").where("url is not null and url <> ''").distinct()
    store.remove(stage(ledger.select("ingest_ord", "url").join(gone, "url", "left_semi"), "purged").df)
    if log_path is not None:
        L.purge_logs(store.spark, log_path)
    return report
