"""Score formulas: popularity, freshness, ratings, consensus, quality, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def popularity(mentions: Column, videos: Column) -> Column:
    """0.6 of the mentions (full at 20) and 0.4 of the videos (full at 10)."""
    return F.round(0.6 * F.least(F.lit(1.0), mentions / 20) + 0.4 * F.least(F.lit(1.0), videos / 10), 3)


def freshness(days: Column) -> Column:
    """1 down to 0.2 at 30, 90, 180 and 365 days; 0.5 if the age is unknown."""
    return F.when(days.isNull(), 0.5).when(days <= 30, 1.0).when(days <= 90, 0.8).when(days <= 180, 0.6).when(days <= 365, 0.4).otherwise(0.2)


def consensus(rows: DataFrame, key: str, feeling: str, profile: str) -> DataFrame:
    """Mean of the largest shares of one feeling and of one profile, with the dominant feeling."""
    n = rows.groupBy(key, feeling).agg(F.count("*").alias("n")).groupBy(key).agg((F.max("n") / F.sum("n")).alias("a"), F.max_by(feeling, F.struct("n", feeling)).alias("dominant_sentiment"))
    p = rows.groupBy(key, profile).agg(F.count("*").alias("n")).groupBy(key).agg((F.max("n") / F.sum("n")).alias("b"))
    return n.join(p, key).select(key, "dominant_sentiment", F.round((F.col("a") + F.col("b")) / 2, 6).alias("consensus"))


def weighted_rating(rows: DataFrame, key: str) -> DataFrame:
    """Explicit ratings and the rating that sentiment implies, weighted by their number and by confidence."""
    implied = F.when(F.col("sentiment") == "positive", 5.0).when(F.col("sentiment") == "negative", 1.0).otherwise(3.0)
    a = rows.groupBy(key).agg(F.count("rating").alias("ratings"), F.avg("rating").alias("r"), F.avg(implied).alias("s"), F.avg("confidence_score").alias("c"))
    wr = F.when(F.col("ratings") > 0, F.least(F.lit(0.5), 0.4 + 0.05 * (F.col("ratings") - 1))).otherwise(0.0)
    ws = 0.3 * F.coalesce("c", F.lit(0.0))
    return a.select(key, "ratings", F.round(F.try_divide(F.coalesce("r", F.lit(0.0)) * wr + F.col("s") * ws, F.nullif(wr + ws, F.lit(0.0))), 6).alias("rating"))


def insight_quality(length: Column, confidence: Column, mentions: Column, completeness: Column) -> Column:
    return 0.25 * F.least(F.lit(1.0), length / 200.0) + 0.35 * confidence + 0.25 * F.least(F.lit(1.0), mentions / 10.0) + 0.15 * completeness


def entropy(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Entropy of a key's counts, scaled to 1 for equal ones, and the number of kinds."""
    total = counts.groupBy(key).agg(F.sum(n).alias("t"), F.count("*").alias("types"))
    share = F.col(n) / F.col("t")
    out = counts.join(total, key).groupBy(key, "types").agg(F.sum(-share * F.log(share)).alias("h"))
    return out.select(key, F.round(F.when(F.col("types") == 1, 0.0).otherwise(F.col("h") / F.log("types")), 6).alias("type_entropy"), "types")


def relevance(similarity: Column, rating: Column, mentions: Column, interests: Column) -> Column:
    return F.round(0.4 * similarity + 0.3 * rating / 5 + 0.2 * F.least(F.log1p(mentions) / 3, F.lit(1.0)) + 0.1 * interests, 3)
