"""Tiered resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import resolution
from tidemark.plans.catalog import register
from tidemark.session import table


def _even(pairs: DataFrame) -> DataFrame:
    """A deterministic stand-in of the verifier: pairs whose ids add up to an even number are one, in doubt at a multiple of ten."""
    total = F.col("a") + F.col("b")
    return pairs.select("a", "b", "score", (total % 2 == 0).alias("verdict"), F.when(total % 10 == 0, 0.5).otherwise(0.9).alias("confidence"))


_S = "(select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"


@register(f"""with recursive f as (select vec_id, min(vec_id) over (partition by label, vec_id % 97) as a from embeddings), e as (select a, vec_id as b from f where a <> vec_id union select a, b from {_S} where s >= 0.5 or (s >= 0.4 and (a + b) % 2 = 0 and (a + b) % 10 <> 0)),
u as (select a, b from e union all select b, a from e), r(id, root) as (select vec_id, vec_id from embeddings union select u.b, r.root from r join u on r.id = u.a) select id as vec_id, min(root) as component from r group by 1""")
def insight_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Groups of insights: equal signatures, close meaning, and less close meaning where verified."""
    v = table(spark, d, "embeddings")
    form = F.concat_ws("|", F.col("label").cast("string"), (F.col("vec_id") % 97).cast("string"))
    return resolution.insight_tiers(v, "vec_id", "label", form, "embedding", _even, 0.5, 0.4)


@register()
def in_video_matches(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of a video that may be one entity; the ratio isn't in SQL, checked against brute force in the tests."""
    m = table(spark, d, "extracted_entities").where("video_id is not null and entity_name is not null")
    return resolution.in_group_matches(m, "video_id", "entity_type", "entity_name", "location")


@register()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The trail of four tiers over the canonical entities; the ratio isn't in SQL, checked against brute force in the tests."""
    c = table(spark, d, "canonical_entities").join(table(spark, d, "embeddings").withColumnRenamed("vec_id", "entity_no"), "entity_no", "left")
    return resolution.entity_tiers(c, "entity_no", ["entity_type", "city"], "canonical_name", "embedding", _even, 0.75, 0.6, 0.4)
