"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazette.llm import align, ann, jaccard, langid, licenses, lm, mixing, packing, phrases, pii, quality, sitetree, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_language_id": langid.op3_language_id,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_url_filter": urls.op6_url_filter,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_html_extraction": sitetree.op10_html_extraction,
    "op11_pii": pii.op11_pii,
    "op12_phrase_mining": phrases.op12_phrase_mining,
    "op13_tokenizer_alignment": align.op13_tokenizer_alignment,
}
SQL: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op6_url_filter": urls.SQL,
    "op9_source_mix": mixing.SQL,
    "op11_pii": pii.SQL,
    "op12_phrase_mining": phrases.SQL,
}
