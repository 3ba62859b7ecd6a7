"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import byte_cnn, jaccard_join, language_spans, link_trust, markov_secrets, merkle, packing, quality_rules, repeats, separators, surrogates, templates, vector_codes


#: The query's key of surrogates; users of the operator pass their own.
KEY = "registered query"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_t(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_t(spark, sf_dir, "documents"), KEY)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counts(_t(spark, sf_dir, "documents"))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(_t(spark, sf_dir, "pages"), tolerance=link_trust.TOLERANCE).select("page_id", "host", "path", "rule", "verdict")


def link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's steps, over pages that are made to link to each other, as the tables' own pages hardly do."""
    judged = link_trust.judge(link_trust.linked(_t(spark, sf_dir, "pages")))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("distrust", 6).alias("distrust"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.digest(markov_secrets.scan(_t(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_t(spark, sf_dir, "documents"))


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    found = language_spans.identify(docs)
    return found.select("doc_id", language_spans.in_part().alias("held_out"), "lang_pred", "score", language_spans.joined("spans").alias("spans"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = byte_cnn.classify(_t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "labels"))
    return scored.select("doc_id", byte_cnn.is_held_out().alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_t(spark, sf_dir, "embeddings")).drop("label")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_t(spark, sf_dir, "documents"), merkle.tampered())


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_t(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lexical_packing": op1_lexical_packing,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_surrogates": op3_surrogates,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_separator_scan": op5_separator_scan,
    "op6_link_trust": op6_link_trust,
    "link_propagation": link_propagation,
    "op7_markov_secrets": op7_markov_secrets,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_language_spans": op9_language_spans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op2_weak_supervision": quality_rules.oracle(),
    "op6_link_trust": link_trust.oracle(),
    "link_propagation": link_trust.linked_oracle(),
    "op11_vector_codes": vector_codes.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
    "op13_substring_dedup": repeats.oracle(),
}
