"""Merging a new record into a known one, field by field, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_name


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def union_sorted(old: Column, new: Column) -> Column:
    """Sorted union of two lists, nulls left out; empty for two nulls."""
    return F.array_compact(F.array_sort(F.array_union(_array(old), _array(new))))


def union_ordered(old: Column, new: Column, most: int | None = None) -> Column:
    """Union in order of first appearance, spellings that differ in case only once, the first `most` where given."""
    every = F.array_compact(F.concat(_array(old), _array(new)))
    once = F.aggregate(every, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))
    return once if most is None else F.slice(once, 1, most)


def merge_aliases(old: Column, new: Column, name: Column) -> Column:
    """Sorted union of aliases without those that normalise to nothing or to the canonical name."""
    both = F.array_distinct(F.array_compact(F.concat(_array(old), _array(new))))
    return F.array_sort(F.filter(both, lambda a: (normalize_name(a) != "") & (normalize_name(a) != F.coalesce(normalize_name(name), F.lit("")))))


def mean_confidence(old: Column, new: Column) -> Column:
    """Mean of two confidences, 0.5 standing for a missing one; null where there is neither."""
    return F.when(old.isNotNull() | new.isNotNull(), F.round((F.coalesce(old, F.lit(0.5)) + F.coalesce(new, F.lit(0.5))) / 2 + 1e-9, 3))


def better_point(old: Column, new: Column) -> Column:
    """The struct (latitude, longitude, confidence) of higher confidence, the old one on a tie; a missing latitude never wins."""
    has_old, has_new = old["latitude"].isNotNull(), new["latitude"].isNotNull()
    higher = F.coalesce(new["confidence"], F.lit(0.0)) > F.coalesce(old["confidence"], F.lit(0.0))
    return F.when(has_new & (~has_old | higher), new).when(has_old, old)


def first_known(old: Column, new: Column) -> Column:
    """The old value unless it is missing, blank or 'unknown'."""
    told = (F.length(F.trim(old)) > 0) & (F.lower(F.trim(old)) != "unknown")
    return F.when(told, old).otherwise(F.coalesce(new, old))


def match_or_create(known: DataFrame, offered: DataFrame, keys: list[str], known_id: str, sums: list[str]) -> DataFrame:
    """`known` with `offered` merged in by equal keys: keys, known_id, sums, status ('merged', 'created', 'untouched').

    Offered rows of equal keys are added up first, so a hot key is pre-aggregated before it is joined. Null keys are
    equal. Several known rows of one key: the smallest id takes what is offered.
    """
    new = offered.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumn("_new", F.lit(True))
    first = known.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(known_id)) == 1)
    renamed = new.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.col("_first")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = first.join(renamed, on, "full")
    status = F.when(F.col(known_id).isNull(), "created").when(F.col("_new"), "merged").otherwise("untouched")
    total = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], known_id, *total, status.alias("status"))


def stage_states(events: DataFrame, key: str, stage: str, op: str, ts: str, tie: str) -> DataFrame:
    """Fold of every stage's operations in order: key, stage, status, retry_count, seconds.

    A fail, and a start after a fail, each add a retry; a reset takes the retries back to none; seconds add up from each
    completion to the start before it. Windows by key and stage, so no key's events are gathered.
    """
    w = Window.partitionBy(key, stage).orderBy(ts, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where(F.col(op).isin("register", "start", "complete", "fail", "reset")).withColumns(
        {
            "_before": F.lag(op).over(w), "_era": F.count_if(F.col(op) == "reset").over(upto),
            "_start": F.last(F.when(F.col(op) == "start", F.col(ts)), ignorenulls=True).over(upto),
        }
    )
    again = (F.col(op) == "fail") | ((F.col(op) == "start") & (F.col("_before") == "fail"))
    took = F.when((F.col(op) == "complete") & (F.col("_before") == "start"), F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("_start").cast("timestamp")))
    g = rows.groupBy(key, stage, "_era").agg(F.count_if(again).alias("retries"), F.sum(took).alias("took"), F.max(F.struct(ts, tie, op)).alias("last"))
    g = g.groupBy(key, stage).agg(F.max_by("retries", "_era").alias("retry_count"), F.coalesce(F.sum("took"), F.lit(0)).alias("seconds"), F.max("last").alias("last"))
    last = F.col(f"last.{op}")
    status = F.when(last == "complete", "complete").when(last == "fail", "failed").when(last == "start", "processing").otherwise("pending")
    return g.select(key, stage, status.alias("status"), "retry_count", "seconds")


def pending_stages(states: DataFrame, key: str, stage: str, most: int = 3) -> DataFrame:
    """Stages to be worked on: neither complete nor processing, fewer than `most` retries, the stage before complete (or the first)."""
    before = states.where("status = 'complete'").select(F.col(key), (F.col(stage) + 1).alias(stage), F.lit(True).alias("_ready"))
    open_ = states.where(F.col("status").isin("pending", "failed") & (F.col("retry_count") < most))
    return open_.join(before, [key, stage], "left").where(F.col("_ready") | (F.col(stage) == 1)).drop("_ready")


def fresh_results(cache: DataFrame, key: str, at: str, now: Column, ttl: int = 3600) -> DataFrame:
    """The last entry of each key of a result cache that is at most `ttl` seconds old."""
    last = cache.groupBy(key).agg(F.max(at).alias(at))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return last.where(age <= ttl)


def cached_or_asked(rows: DataFrame, cache: DataFrame, keys: list[str], values: list[str], ask) -> DataFrame:
    """`rows` with `values` from a cache, and from `ask` (a function of the distinct keys missing) where it has none: found_in.

    The answers of `ask` stay null where it has none; null keys are looked up like others.
    """
    want = rows.select(*keys).distinct()
    hit = cache.select(*keys, *values).dropDuplicates(keys)
    missing = want.join(hit, keys, "left_anti")
    told = hit.withColumn("found_in", F.lit("cache")).unionByName(ask(missing).select(*keys, *values).withColumn("found_in", F.lit("asked")))
    return rows.join(told, keys, "left").withColumn("found_in", F.coalesce("found_in", F.lit("nowhere")))
