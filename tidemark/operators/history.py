"""Time series and rank-dependent scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(rows: DataFrame, key: list[str], ts: str, tie: str, value: str, days: int) -> DataFrame:
    """First against last value of each key in the last `days` before the newest row; at least two points; nulls don't count.

    Columns: key, points, change, change_pct (0 where the first value is 0), trend.
    """
    newest = rows.agg(F.max(ts).alias("_t"))
    rows = rows.join(F.broadcast(newest)).where((F.col(ts) >= F.col("_t") - F.expr(f"interval {days} days")) & F.col(value).isNotNull())
    order = F.struct(ts, tie)
    g = rows.groupBy(*key).agg(F.count("*").alias("points"), F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b")).where("points >= 2")
    change = F.col("b") - F.col("a")
    label = F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("stable")
    pct = F.when(F.col("a") == 0, 0.0).otherwise(100 * change / F.col("a"))
    return g.select(*key, "points", F.round(change, 6).alias("change"), F.round(pct, 4).alias("change_pct"), label.alias("trend"))


def quota_sample(rows: DataFrame, kind: str, quota: dict[str, int], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows, those within their kind's quota first, the rest as backfill."""
    pos = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), tie))
    limit = F.coalesce(*[F.when(F.col(kind) == name, n) for name, n in quota.items()], F.lit(0))
    return rows.withColumn("_late", (pos > limit).cast("int")).orderBy("_late", F.desc(score), tie).limit(k).drop("_late")


def penalised(rows: DataFrame, kind: str, score: str, tie: str) -> DataFrame:
    """Scores less 0.3 (i - 1) / 10 from the third row of a kind on (i from 0), not below 0; kinds of one or two are kept."""
    i = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), tie)) - 1
    rows = rows.withColumns({"_i": i, "_n": F.count("*").over(Window.partitionBy(kind))})
    cut = F.greatest(F.lit(0.0), F.col(score) - 0.3 * (F.col("_i") - 1) / 10.0)
    return rows.withColumn("score", F.when((F.col("_n") > 2) & (F.col("_i") >= 2), cut).otherwise(F.col(score))).drop("_i", "_n")


def sequence_ids(rows: DataFrame, kind: str, city: str, order: str) -> DataFrame:
    """kind_city_NNN, numbered within each kind and city."""
    from tidemark.functions.text import city_key

    n = F.row_number().over(Window.partitionBy(kind, city).orderBy(order)).cast("string")
    return rows.select(order, F.concat_ws("_", F.col(kind), city_key(F.col(city)), F.lpad(n, 3, "0")).alias("new_id"))
