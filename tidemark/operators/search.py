"""Vector and keyword search, rank fusion, re-ranking, city allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vector import cosine


def knn(rows: DataFrame, row_id: str, vector: str, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to the one row of `query` (column q) by cosine: row_id, similarity. The filter comes before the top-k."""
    rows = rows.where(where) if where is not None else rows
    scored = rows.join(F.broadcast(query)).select(row_id, F.round(cosine(F.col(vector), F.col("q")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), row_id).limit(k)


def keyword_score(text: Column, terms: list[str]) -> Column:
    """Share of the terms that a text contains."""
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(text).contains(t))
    return F.size(hits) / len(terms)


def rrf(lists: list[DataFrame], row_id: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with columns row_id, rank (from 0): row_id, score."""
    every = lists[0].select(row_id, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(row_id, "rank"))
    return every.groupBy(row_id).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def ranks(rows: DataFrame, row_id: str, score: str, k: int) -> DataFrame:
    """The k best rows with their rank from 0; only the k are ordered in one place."""
    top = rows.orderBy(F.desc(score), row_id).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), row_id)) - 1)


def rerank(strategy: str, similarity: Column, rating: Column, mentions: Column, km: Column) -> Column:
    """Score by strategy: balanced, quality, popular or distance (falling to 0 at 50 km)."""
    popular = F.least(mentions / 100.0, F.lit(1.0))
    return {
        "balanced": 0.4 * similarity + 0.3 * rating / 5 + 0.3 * popular,
        "quality": 0.3 * similarity + 0.6 * rating / 5 + 0.1 * popular,
        "popular": 0.3 * similarity + 0.1 * rating / 5 + 0.6 * popular,
        "distance": 0.5 * similarity + 0.5 * F.greatest(1 - km / 50.0, F.lit(0.0)),
    }[strategy]


def fuse_profiles(rows: DataFrame, row_id: str, profile: str, primary: str, score: str) -> DataFrame:
    """Weighted sum over profiles: 0.7 for the primary one, the rest shared by the others."""
    others = rows.where(F.col(profile) != primary).agg(F.greatest(F.countDistinct(profile), F.lit(1)).alias("m"))
    w = F.when(F.col(profile) == primary, 0.7).otherwise(0.3 / F.col("m"))
    return rows.join(F.broadcast(others)).groupBy(row_id).agg(F.round(F.sum(w * F.col(score)), 6).alias("score"))


def allocate_days(rows: DataFrame, city: str, score: str, days: int) -> DataFrame:
    """Days by largest share of score, at least one each, the rest to the first; rows are the few chosen cities."""
    w = Window.partitionBy(F.lit(1))
    base = F.greatest(F.lit(1), F.floor(days * F.col(score) / F.sum(score).over(w)).cast("int"))
    rows = rows.withColumn("base", base)
    left = F.lit(days) - F.sum("base").over(w)
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), city)) == 1
    return rows.select(city, F.when(first, F.greatest(F.lit(1), F.col("base") + left)).otherwise(F.col("base")).cast("int").alias("days"))
