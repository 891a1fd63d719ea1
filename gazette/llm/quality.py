"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a number per document and a list of cutoffs from lenient to strict that is
fixed beforehand. For each stratum (a language) and rule the cutoffs are tested in that
order on the distinct good labelled texts: the hypothesis "more than ``alpha / rules`` of
the good documents lie beyond this cutoff" is rejected when the exact binomial probability
of so few of them is at most ``delta / (strata * rules)``. Testing stops at the first
cutoff that fails, so all accepted cutoffs hold together with probability 1 - ``delta``,
and the rules of one stratum together lose at most ``alpha`` of its good documents. Among
the certified cutoffs the one that gains most is used, ``loss_weight`` good documents lost
counting as much as one bad document caught; on a tie the more lenient one, and none if
nothing is gained. Everything runs as DataFrame expressions.

Defined results: null text is empty text and fails the base rule; a null stratum is a
stratum of its own; a stratum with too few labels certifies nothing and loses nothing;
labels with null ``doc_id`` or null ``quality`` are ignored; a ``doc_id`` labelled twice
counts as good if any label says so, and so do copies of one text within a stratum; empty
labels give no cutoffs; repeated documents are judged row by row; other columns of the
input, whatever their names, are carried along by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.common import let
from gazette.llm.tables import BLANKS, keep, table, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document is rejected when ``name``, a share or a length, exceeds the cutoff."""

    name: str
    over: str
    under: str
    cutoffs: tuple[float, ...]


#: Rules and their cutoffs, lenient to strict: numerator and denominator are base columns.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.025)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("repeats", "n_repeat_words", "n_words", (0.25, 0.2, 0.15, 0.1, 0.05)),
    Rule("word_length", "word_chars", "n_words", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0)),
)


@dataclass(frozen=True)
class Risk:
    """``alpha``: share of a stratum's good documents that may be lost; ``delta``: risk that it is more."""

    alpha: float = 0.04
    delta: float = 0.05
    loss_weight: float = 10.0


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of eight words found at least twice in the text."""

    def covered(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = lambda x, i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["k"] == x["k"])
            twice = F.filter(s, lambda x, i: F.coalesce(same(x, i, i - 1), F.lit(False)) | F.coalesce(same(x, i, i + 1), F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(ranked, count))

    starts = F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))
    keys = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    return F.when(F.size(tokens) < WINDOW + 1, 0).otherwise(let(keys, covered)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_m`` of the base measures.

    Windows are compared by 64-bit hashes within one text.
    """

    def measures(tokens: Column) -> Column:
        body = F.coalesce(F.col(text), F.lit(""))
        lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        n = F.size(tokens).cast("long")
        repeats = _repeat_words(tokens)
        return let(
            F.struct(
                n.alias("n_words"),
                F.char_length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
                (F.char_length(body) - F.char_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("lines"),
                repeats.alias("n_repeat_words"),
            ),
            lambda m: F.struct(
                m["n_words"].alias("n_words"),
                m["word_chars"].alias("word_chars"),
                m["n_symbols"].alias("n_symbols"),
                m["lines"]["dup"].alias("n_dup_lines"),
                m["n_repeat_words"].alias("n_repeat_words"),
                m["lines"]["n"].alias("n_lines"),
                ((m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])).alias("base_failed"),
            ),
        )

    return docs.withColumn("_m", let(words(F.col(text)), measures))


def _share(rule: Rule) -> Column:
    """The rule's number; 0 where there is nothing to divide by."""
    under = F.col(f"_m.{rule.under}")
    return F.when(under > 0, F.col(f"_m.{rule.over}") / under).otherwise(0.0)


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, summed term by term; memory grows with ``k`` only."""
    from math import log

    first = n * F.lit(log(1 - p))
    zero = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, zero, step, lambda a: a["s"])


def certify(held: DataFrame, rules: tuple[Rule, ...] = RULES, risk: Risk = Risk()) -> DataFrame:
    """Cutoff per stratum and rule from held-out rows (``_stratum``, ``_copy``, ``_good``, ``_m``).

    Returns stratum, rule, cutoff, good, lost, bad, caught and p_value of the cutoff in use.
    """
    shares = [_share(r).alias(f"_{r.name}") for r in rules]
    once = held.select("_stratum", "_copy", "_good", *shares).groupBy("_stratum", "_copy").agg(
        F.max("_good").alias("_good"), *[F.first(f"_{r.name}").alias(f"_{r.name}") for r in rules]
    )
    good, bad = F.col("_good") == 1, F.col("_good") == 0
    counts = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    for r in rules:
        for i, cut in enumerate(r.cutoffs):
            over = F.col(f"_{r.name}") > cut
            counts += [F.count_if(good & over).alias(f"{r.name}_{i}_lost"), F.count_if(bad & over).alias(f"{r.name}_{i}_caught")]
    totals = once.groupBy("_stratum").agg(*counts)
    tests = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cutoff"), F.col(f"{r.name}_{i}_lost").alias("lost"), F.col(f"{r.name}_{i}_caught").alias("caught"))
            for r in rules
            for i, cut in enumerate(r.cutoffs)
        ]
    )
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rows = totals.select(F.col("_stratum").alias("stratum"), "good", "bad", strata.alias("strata"), F.explode(tests).alias("t")).select("stratum", "good", "bad", "strata", "t.*")
    rows = rows.withColumn("p_value", _tail(F.col("lost"), F.col("good"), risk.alpha / len(rules)))
    passed = F.col("p_value") <= risk.delta / len(rules) / F.col("strata")
    chain = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col("bad") > 0, F.col("caught") / F.col("bad")).otherwise(0.0) - risk.loss_weight * F.col("lost") / F.col("good")
    rows = rows.where("good > 0").withColumn("ok", F.min(passed).over(chain)).withColumn("gain", gain).where("ok AND gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "i")
    return rows.withColumn("at", F.row_number().over(best)).where("at = 1").select("stratum", "rule", "cutoff", "good", "lost", "bad", "caught", "p_value")


def _held(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of ``measures`` (``_id``, ``_stratum``, ``_copy``, ``_m``)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") >= 1).cast("int").alias("_good"))
    return measures.join(marks, "_id")


def _verdict(rows: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` with ``_kept``; cutoffs are one narrow row per stratum, joined as their size allows."""
    wide = cutoffs.groupBy("stratum").pivot("rule", [r.name for r in rules]).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_of"), F.struct(*[F.col(r.name).cast("double").alias(r.name) for r in rules]).alias("_cut"))
    joined = rows.join(wide, rows["_stratum"].eqNullSafe(wide["_of"]), "left")
    beyond = F.lit(False)
    for r in rules:
        beyond = beyond | F.coalesce(_share(r) > F.col(f"_cut.{r.name}"), F.lit(False))
    return joined.withColumn("_kept", ~F.col("_m.base_failed") & ~beyond).drop("_of", "_cut")


def cutoffs_for(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: Risk = Risk()) -> tuple[DataFrame, DataFrame]:
    """Measures of every document, without its text, and the certified cutoffs; both staged."""
    narrow = measured(docs).select(
        F.col("doc_id").alias("_id"), F.col(stratum).alias("_stratum"), F.md5(F.coalesce("text", F.lit(""))).alias("_copy"), "_m"
    )
    narrow = keep(narrow, "quality")
    return narrow, keep(certify(_held(narrow, labels), rules, risk), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: Risk = Risk()) -> DataFrame:
    """The documents that pass the base rule and the certified cutoffs, with their own columns.

    Texts are measured once; whole rows are staged with their measures, and the certification
    reads the narrow columns of that table only.
    """
    row = F.struct("*").alias("_row")
    body = F.coalesce("_row.text", F.lit("")).alias("_text")
    rows = docs.select(row).select("_row", F.col("_row.doc_id").alias("_id"), F.col(f"_row.{stratum}").alias("_stratum"), body)
    whole = keep(measured(rows, "_text").withColumn("_copy", F.md5("_text")).drop("_text"), "judged")
    cutoffs = keep(certify(_held(whole.select("_id", "_stratum", "_copy", "_m"), labels), rules, risk), "cutoffs")
    return _verdict(whole, cutoffs, rules).where("_kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict."""
    narrow, cutoffs = cutoffs_for(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return _verdict(narrow, cutoffs, RULES).select(F.col("_id").alias("doc_id"), *[f"_m.{c}" for c in base], F.col("_kept").alias("kept"))


def _sql() -> str:
    risk = Risk()
    p, chains = risk.alpha / len(RULES), risk.delta / len(RULES)
    grid = ", ".join(f"('{r.name}', {i}, {c}::DOUBLE)" for r in RULES for i, c in enumerate(r.cutoffs))
    shares = " ".join(f"WHEN '{r.name}' THEN (CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under} ELSE 0 END)" for r in RULES)
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) > {WINDOW}),
keyed AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS k FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
spots AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM twice WHERE c > 1),
reps AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - b, {WINDOW}))) AS n FROM spots GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, md5(text) AS copy, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
        FROM w LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
grid(rule, i, cutoff) AS (VALUES {grid}),
marks AS (SELECT doc_id, (max(quality) >= 1)::INT AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
once AS (SELECT lang, copy, max(good) AS good, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
        any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words, any_value(n_lines) AS n_lines
        FROM b JOIN marks USING (doc_id) GROUP BY 1, 2),
tests AS (SELECT lang, rule, i, cutoff, count(*) FILTER (good = 1) AS good, count(*) FILTER (good = 0) AS bad,
        count(*) FILTER (good = 1 AND (CASE rule {shares} END) > cutoff) AS lost,
        count(*) FILTER (good = 0 AND (CASE rule {shares} END) > cutoff) AS caught
        FROM once, grid GROUP BY 1, 2, 3, 4),
ps AS (SELECT *, list_sum(list_transform(range(0, lost + 1), lambda x: exp(lgamma(good + 1) - lgamma(x + 1) - lgamma(good - x + 1)
        + x * ln({p}::DOUBLE) + (good - x) * ln(1 - {p}::DOUBLE)))) AS p_value, (SELECT count(*) FROM (SELECT DISTINCT lang FROM once)) AS strata
        FROM tests WHERE good > 0),
ok AS (SELECT *, bool_and(p_value <= {chains} / strata) OVER (PARTITION BY lang, rule ORDER BY i) AS ok,
        (CASE WHEN bad > 0 THEN caught::DOUBLE / bad ELSE 0 END) - {risk.loss_weight} * lost / good AS gain FROM ps),
best AS (SELECT lang, rule, cutoff FROM ok WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, i) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.lang IS NOT DISTINCT FROM b.lang
        AND (CASE rule {shares} END) > cutoff) AS kept FROM b"""


SQL = _sql()
