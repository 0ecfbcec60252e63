"""Operators whose rules depend on the order of rows, and kernels in Python: one group, or one batch of rows, at a time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import ratio_udf


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(1.0, h)))


def greedy(points: list[tuple[float, float]], km: float) -> list[int]:
    """Number of the first seed within `km` of each point, in order; a point without one becomes a seed.

    Seeds are kept in grid cells of that size, so a point looks at the cells around it only.
    """
    step, cells, out, seeds = km / 110.0, {}, [], []
    for lat, lon in points:
        row = math.floor(lat / step)
        wide = lambda r: step / max(math.cos(math.radians(r * step)), 0.02)  # noqa: B023, E731
        near = [s for r in (row - 1, row, row + 1) for c in range(math.floor(lon / wide(r)) - 1, math.floor(lon / wide(r)) + 2) for s in cells.get((r, c), ())]
        hit = min((s for s in near if _km(seeds[s], (lat, lon)) <= km), default=None)
        if hit is None:
            hit = len(seeds)
            seeds.append((lat, lon))
            cells.setdefault((row, math.floor(lon / wide(row))), []).append(hit)
        out.append(hit)
    return out


def greedy_clusters(rows: DataFrame, key: str, tie: str, lat: str, lon: str, km: float) -> DataFrame:
    """Cluster number of each located row within its key: key, tie, cluster."""

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"key": group[0], "id": pdf["id"], "cluster": greedy(list(zip(pdf["lat"], pdf["lon"], strict=True)), km)})

    rows = rows.select(F.col(key).alias("key"), F.col(tie).cast("long").alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return rows.groupBy("key").applyInPandas(run, "key string, id long, cluster long").withColumnsRenamed({"key": key, "id": tie})


def search_names(rows: DataFrame, row_id: str, name: str, aliases: str, query: str, least: float) -> DataFrame:
    """Rows by the best partial ratio (0 to 100) of their name and aliases with the query: row_id, score."""
    names = rows.select(row_id, F.explode(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), F.col(name))).alias("n")).where("n is not null")
    score = F.round(100 * ratio_udf("partial")(F.lower("n"), F.lit(query)), 4)
    return names.select(row_id, score.alias("s")).groupBy(row_id).agg(F.max("s").alias("score")).where(F.col("score") >= least)


def correct_words(typed: DataFrame, known: DataFrame, word: str, target: str, least: float) -> DataFrame:
    """Best known word of each typed one, of all pairs whose letters can make the ratio at all; `known` is a fixed, small list.

    The ratio is at most 2 c / (n + m), c being the letters in common (each as often as in both). Words that are known
    already stay out; ties go to the first in order.
    """
    def letters(c: str) -> Column:
        """Each letter with its number among its equals, so that letters in common are counted as often as in both."""
        x = F.split(F.col(c), "")
        return F.transform(x, lambda a, i: F.concat(a, F.size(F.filter(F.slice(x, 1, i + 1), lambda b: b == a)).cast("string")))

    a = typed.join(known, typed[word] == known[target], "left_anti").select(word).distinct().withColumn("_a", letters(word))
    b = known.select(target).distinct().withColumn("_b", letters(target))
    size = F.length(word) + F.length(target)
    pairs = a.crossJoin(F.broadcast(b)).where(2 * F.least(F.length(word), F.length(target)) >= (least - 1e-6) * size)
    pairs = pairs.where(2 * F.size(F.array_intersect("_a", "_b")) >= (least - 1e-6) * size).select(word, target)
    scored = pairs.withColumn("_ratio", F.round(ratio_udf("sequence")(word, target), 6)).where(F.col("_ratio") >= least)
    return scored.groupBy(word).agg(F.min_by(F.struct(F.col(target), F.col("_ratio").alias("ratio")), F.struct(-F.col("_ratio"), target)).alias("b")).select(word, f"b.{target}", "b.ratio")
