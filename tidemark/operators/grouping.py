"""Groups of equal records: signatures, canonical names, alias sets, attribute and in-video merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import signature


def exact_groups(rows: DataFrame, name: str, location: str, kind: str, row_id: str) -> DataFrame:
    """Signatures borne by more than one row; rows with an empty name are left out, a null location counts as ''."""
    named = rows.where(F.coalesce(F.trim(name), F.lit("")) != "")
    sig = signature(F.col(name), F.col(location), F.col(kind)).alias("signature")
    return named.groupBy(sig).agg(F.count("*").alias("mentions"), F.min(row_id).alias("first_mention")).where("mentions > 1")


def _ranked(rows: DataFrame, group: str, name: str) -> DataFrame:
    n = rows.where(F.col(name).isNotNull()).groupBy(group, name).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(group).orderBy(F.desc("_n"), F.desc(F.length(name)), name)
    return n.withColumns({"_at": F.row_number().over(order), "_k": F.count("*").over(Window.partitionBy(group))})


def mode_name(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Most frequent name of each group; ties go to the longest, then to the first in order. Null names don't count."""
    return _ranked(rows, group, name).where("_at = 1").select(group, name, F.col("_n").alias("name_count"), (F.col("_k") - 1).alias("alternatives"))


def alias_sets(rows: DataFrame, group: str, name: str) -> DataFrame:
    """mode_name with the other names, sorted and joined by a bar."""
    ranked = _ranked(rows, group, name)
    others = F.array_join(F.array_sort(F.collect_set(F.when(F.col("_at") > 1, F.col(name)))), "|")
    return ranked.groupBy(group).agg(F.max(F.when(F.col("_at") == 1, F.col(name))).alias(name), others.alias("aliases"))


def frequent_values(rows: DataFrame, key: str, values: str, position: str, out: str) -> DataFrame:
    """Values of an array column by frequency, then by first appearance, joined by commas."""
    n = rows.select(key, F.explode(values).alias("v"), position).where("v is not null").groupBy(key, "v").agg(F.count("*").alias("n"), F.min(position).alias("f"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "f", "v")))
    return n.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["v"]), ",").alias(out))


def merge_in_video(rows: DataFrame) -> DataFrame:
    """Mentions of one name in one video as one: best confidence, first time, joint sentiment, distinct costs."""
    feeling = F.when(F.countDistinct("sentiment") <= 1, F.coalesce(F.min("sentiment"), F.lit("neutral"))).otherwise("mixed")
    return rows.groupBy("video_id", F.trim(F.lower("entity_name")).alias("name")).agg(
        F.max("confidence_score").alias("confidence"), F.min("timestamp_start").alias("first_at"), feeling.alias("sentiment"),
        F.array_join(F.array_sort(F.collect_set("cost_mentioned")), ", ").alias("costs"),
    )
