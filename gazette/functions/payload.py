"""Analysis payloads: fence removal, parsing, defaults and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import strip_whitespace
from gazette.schemas import ANALYSIS

_BROKEN = "_broken"
_PARSED = T.StructType(ANALYSIS.fields + [T.StructField(_BROKEN, T.StringType())])

# What stands in for an answer that could not be obtained.
FAILED_SCORE = 5.0
FAILED_SUMMARY = "Erreur lors de l'analyse"


def strip_fences(c: Column) -> Column:
    """Remove Markdown code fences around JSON."""
    text = F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return strip_whitespace(text)


def parse_analysis(c: Column) -> Column:
    """Struct of the payload fields plus ``parse_ok``.

    ``parse_ok`` is false for null text, text that is not JSON, JSON that is not an
    object, anything before or after the object and fields of the wrong type (the other
    fields of such a row survive).
    """
    parsed = F.from_json(
        strip_fences(c),
        _PARSED,
        {
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": _BROKEN,
            "allowSingleQuotes": "false",
        },
    )
    # the parser stops after the first object; as a list, only a single object has length 1
    alone = F.json_array_length(F.concat(F.lit("["), strip_fences(c), F.lit("]"))) == 1
    ok = F.coalesce(parsed.isNotNull() & alone & parsed[_BROKEN].isNull() & (F.btrim(c) != ""), F.lit(False))
    fields = [parsed[name].alias(name) for name in ANALYSIS.names]
    return F.struct(*fields, ok.alias("parse_ok"))


def ledger_analysis(parsed: Column) -> Column:
    """The payload kept with a ledger row: an empty object unless it could be parsed."""
    nothing = F.from_json(F.lit("{}"), ANALYSIS)
    fields = F.struct(*[parsed[name].alias(name) for name in ANALYSIS.names])
    return F.when(parsed["parse_ok"], fields).otherwise(nothing)


def analysis_defaults(parsed: Column, raw: Column) -> Column:
    """Payload for the output record: every missing field gets its default, and text that
    is not JSON becomes the summary itself."""
    ok = parsed["parse_ok"]
    return F.struct(
        F.coalesce(F.when(ok, parsed["isDouble"]), F.lit(False)).alias("isDouble"),
        F.when(ok, parsed["similarArticle"]).alias("similarArticle"),
        F.when(ok, parsed["similarityReason"]).alias("similarityReason"),
        F.coalesce(F.when(ok, parsed["isCommercial"]), F.lit(False)).alias("isCommercial"),
        F.coalesce(F.when(ok, parsed["significanceScore"]), F.lit(0.0)).alias("significanceScore"),
        F.coalesce(F.when(ok, parsed["summary"]).otherwise(strip_fences(raw)), F.lit("")).alias("summary"),
        F.coalesce(F.when(ok, parsed["tags"]), F.array().cast("array<string>")).alias("tags"),
    )


def payload_problems(parsed: Column) -> Column:
    """Names of the rules a payload breaks, in fixed order; empty when it is sound."""
    score, tags = parsed["significanceScore"], parsed["tags"]
    only = F.get(tags, F.lit(0))
    rules = [
        ("unparsed", ~parsed["parse_ok"]),
        ("score_missing", score.isNull()),
        ("score_range", ~score.between(0.0, 10.0)),
        ("summary_missing", F.coalesce(parsed["summary"], F.lit("")) == ""),
        ("tag_count", F.coalesce(F.size(tags), F.lit(0)) != 1),
        ("tag_capital", F.substring(only, 1, 1) != F.upper(F.substring(only, 1, 1))),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
