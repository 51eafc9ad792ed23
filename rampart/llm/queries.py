"""Queries of the corpus operators over the whole tables, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm import ann_projection, chat_format, decontaminate, embedding_dedup, language_id, mixing, ngram_join, rule_ensemble, sharding, spelling, suffix_dedup, url_filter, vector_codes
from rampart.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate for the default target weights, domains learnt from the labels table."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels that aren't held out."""
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose texts hold control strings."""
    tricky = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "select cast(conv_id as long) conv_id, cast(turn as long) turn, role, :said as text from values (-1, 0, 'user'), (-1, 1, 'assistant') as t(conv_id, turn, role)",
        args={"said": tricky},
    )
    return chat_format.conversation_digests(own.union(extra))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each one whose number is divisible by 20."""
    return ann_projection.nearest(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learnt from those that aren't held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under five-word shingles and a similarity of 0.8."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that also start elsewhere."""
    return suffix_dedup.repeats_report(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; a page's labelled outcome is the quality label of its number in labels."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.9, and its component."""
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with its near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector's product code, and its error."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from rampart.llm import sql

    return {name: text for name, text in vars(sql).items() if name.startswith("op") and isinstance(text, str)}
