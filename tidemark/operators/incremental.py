"""Incremental merges, snapshots, upserts and the stage machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, key: str, sums: list[str], latest: list[str], ts: str) -> DataFrame:
    """One row per key of both tables: sums added, the `latest` columns of the newest row (new beats old on equal ts), status."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(ts, "_new")
    g = both.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max_by(c, order).alias(c) for c in latest], F.max(ts).alias(ts), F.min("_new").alias("_a"), F.max("_new").alias("_b")
    )
    status = F.when(F.col("_a") != F.col("_b"), "merged").when(F.col("_a") == 1, "created").otherwise("untouched")
    return g.withColumn("status", status).drop("_a", "_b")


def replay(events: DataFrame, key: str, op: str, ts: str, tie: str) -> DataFrame:
    """Fold of a stage's operations in order: status, starts, fails, retries (a fail, and a start after a fail, each add one).

    Expressed over windows, so no key's events are gathered in one place; a key in its final state keeps the last one.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    before = F.lag(op).over(w)
    rows = events.where(F.col(op).isin("register", "start", "complete", "fail", "reset")).withColumn("_before", before)
    again = (F.col(op) == "start") & (F.col("_before") == "fail")
    last = F.max_by(op, F.struct(ts, tie))
    return rows.groupBy(key).agg(
        last.alias("last"), F.count_if(F.col(op) == "start").alias("starts"), F.count_if(F.col(op) == "fail").alias("fails"), F.count_if((F.col(op) == "fail") | again).alias("retry_count")
    ).select(
        key, F.when(F.col("last") == "complete", "complete").when(F.col("last") == "fail", "failed").when(F.col("last") == "start", "processing").otherwise("pending").alias("status"),
        "starts", "fails", "retry_count",
    )


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`target` with the rows of `changes` put in place of, or beside, those of equal key; the last row of a key wins by all columns' order."""
    once = changes.groupBy(key).agg(F.max(F.struct(*[c for c in changes.columns if c != key])).alias("r")).select(key, "r.*")
    return target.join(once.select(key), key, "left_anti").unionByName(once.select(*target.columns))
