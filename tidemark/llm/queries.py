"""Queries of the training-data operators, over the whole tables of a scale folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fusion, history, language, mixing, places, safety, tokens, turns, variants
from tidemark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return places.found(table(spark, d, "extracted_entities"), table(spark, d, "places"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return places.unmatched(table(spark, d, "extracted_entities"), table(spark, d, "places"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "videos"), table(spark, d, "transcripts"), table(spark, d, "documents"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segment_languages(table(spark, d, "videos"), table(spark, d, "transcripts"), table(spark, d, "documents"))


def p2_videos(spark: SparkSession, d: str) -> DataFrame:
    return language.video_languages(table(spark, d, "videos"), table(spark, d, "transcripts"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.found(table(spark, d, "canonical_snapshots"), table(spark, d, "places"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return fusion.survivors(table(spark, d, "canonical_snapshots"), table(spark, d, "places"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(table(spark, d, "entity_intake"), table(spark, d, "canonical_entities"), table(spark, d, "places"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.found(table(spark, d, "extracted_entities"), table(spark, d, "canonical_entities"), table(spark, d, "places"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.found(table(spark, d, "videos"), table(spark, d, "transcripts"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "videos"), table(spark, d, "transcripts"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return safety.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return safety.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return safety.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_unmatched, p2_found, p2_segments, p2_videos, p3_found, p3_survivors, p4_found, p5_found, p6_found,
        p6_turns, p7_ids, p8_mix, p8_shares, p9_found, p9_scores, p9_rates,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None of these is expressible in SQL over whole tables; they are tested against brute force in tests/llm."""
    return {}
