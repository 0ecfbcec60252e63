"""Traveller profile buckets, metrics per bucket, attribute summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets in order of priority: name, type, tier, styles (a null fits anything).
BUCKETS = [
    ("solo_budget_party", "solo", "budget", ["party", "social", "nightlife"]), ("solo_budget_cultural", "solo", "budget", ["cultural", "history", "temples"]),
    ("solo_budget_adventure", "solo", "budget", ["adventure", "hiking", "nature"]), ("solo_midrange_adventure", "solo", "mid-range", ["adventure", "hiking", "nature"]),
    ("solo_midrange_cultural", "solo", "mid-range", ["cultural", "history"]), ("solo_luxury", "solo", "luxury", []), ("couple_budget", "couple", "budget", []),
    ("couple_midrange_romantic", "couple", "mid-range", ["romantic", "relaxed"]), ("couple_midrange_adventure", "couple", "mid-range", ["adventure", "active"]),
    ("couple_luxury", "couple", "luxury", []), ("family_budget", "family", "budget", []), ("family_midrange", "family", "mid-range", []), ("family_luxury", "family", "luxury", []),
    ("group_party", "group", None, ["party"]), ("group_adventure", "group", None, ["adventure", "hiking"]), ("group_cultural", "group", None, ["cultural", "history"]),
    ("backpacker_social", None, "budget", ["social", "backpacker", "hostel"]), ("backpacker_adventure", None, "budget", ["adventure", "backpacker", "hiking"]),
    ("digital_nomad", "solo", None, ["work", "remote", "digital nomad", "coworking"]),
]


def bucket(kind: Column, tier: Column, styles: Column) -> Column:
    """The bucket of highest score (10 for the type, 10 for the tier, 5 for each style met); the first of equals; other_* without any.

    A bucket whose type or tier differs, or that needs a style and meets none, scores nothing.
    """
    scored = []
    for order, (name, k, t, wanted) in enumerate(BUCKETS):
        hits = F.size(F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.exists(styles, lambda s: s.contains(w)))) if wanted else F.lit(0)
        fits = (kind == k if k else F.lit(True)) & (tier == t if t else F.lit(True)) & ((hits > 0) if wanted else F.lit(True))
        points = F.lit((10 if k else 0) + (10 if t else 0)) + 5 * hits
        scored.append(F.struct(F.when(F.coalesce(fits, F.lit(False)), points).otherwise(0).alias("s"), F.lit(-order).alias("o"), F.lit(name).alias("n")))
    best = F.array_max(F.array(*scored))
    other = F.concat_ws("_", F.lit("other"), F.coalesce(kind, F.lit("unknown")), F.coalesce(tier, F.lit("unknown")))
    return F.when(best["s"] > 0, best["n"]).otherwise(other)


def metrics(rows: DataFrame, key: str, profile: str, feeling: str) -> DataFrame:
    """Per key and profile: rows, mean rating of the feelings (5, 3, 1), confidence (full at ten rows)."""
    value = F.when(F.col(feeling) == "positive", 5.0).when(F.col(feeling) == "negative", 1.0).otherwise(3.0)
    return rows.groupBy(key, profile).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("rating"), F.round(F.least(F.count("*") / 10, F.lit(1.0)), 6).alias("confidence"))


def recommendations(per: DataFrame, key: str, profile: str) -> DataFrame:
    """Profiles a key is best for (rating 4 or more, two rows) and not for (below 3), and the rating weighted by rows."""
    names = lambda test, sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct((sign * F.col("rating")).alias("r"), F.col(profile).alias("p"))))), lambda x: x["p"]), ",")
    enough = F.col("n") >= 2
    return per.groupBy(key).agg(
        names(enough & (F.col("rating") >= 4), -1).alias("best_for"), names(enough & (F.col("rating") < 3), 1).alias("not_for"),
        F.round(F.sum(F.col("rating") * F.col("n")) / F.sum("n"), 6).alias("overall"),
    )


def top_values(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each key (ties by value), joined by commas in that order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_c"), value))
    kept = counts.withColumn("_at", at).where(F.col("_at") <= n)
    order = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["v"]), ",").alias("top"))
