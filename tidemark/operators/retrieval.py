"""Retrieval: predicates built from nested filters, fallbacks, diversification, and the whole plan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price levels of a budget tier (fixed values).
PRICE_LEVELS = {"budget": ["$", "$$"], "mid-range": ["$$", "$$$"], "luxury": ["$$$", "$$$$"]}


def predicate(where: dict[str, Any]) -> Column:
    """A filter from nested conditions: {column: value}, {column: {"$in": [...]}}, {"$and": [...]}, {"$or": [...]}.

    Several keys of one dict are joined by and; $eq, $ne, $in, $nin, $gt, $gte, $lt, $lte compare; an empty dict is true.
    Nulls satisfy no comparison. An unknown operator is an error.
    """
    parts: list[Column] = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            some = [predicate(w) for w in value]
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, some, F.lit(key == "$and")))  # noqa: B023
        elif isinstance(value, dict):
            c = F.col(key)
            for op, x in value.items():
                compare = {
                    "$eq": lambda c, x: c == x, "$ne": lambda c, x: c != x, "$gt": lambda c, x: c > x, "$gte": lambda c, x: c >= x, "$lt": lambda c, x: c < x,
                    "$lte": lambda c, x: c <= x, "$in": lambda c, x: c.isin(x), "$nin": lambda c, x: ~c.isin(x),
                }.get(op)
                if compare is None:
                    raise ValueError(f"unknown operator {op}")
                parts.append(compare(c, x))
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def budget_levels(tier: str) -> dict[str, Any]:
    """The condition on price_level of a budget tier; none for an unknown one."""
    return {"price_level": {"$in": PRICE_LEVELS[tier]}} if tier in PRICE_LEVELS else {}


def exact_then_contains(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose column equals the value whatever its case, or, where there is none at all, those that contain it."""
    low = F.lower(column)
    hits = rows.where(low.contains(wanted.lower())).withColumn("_exact", low == wanted.lower())
    any_exact = hits.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any"))
    return hits.join(F.broadcast(any_exact)).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def per_kind_quota(rows: DataFrame, kind: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows taken in turns over kinds: the best of each kind, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), tie))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= k).orderBy("_turn", F.desc(score), tie).limit(k).drop("_turn")


def diversified(rows: DataFrame, key: str, kind: str, score: str, tie: str, factor: float = 0.3, most: int = 3) -> DataFrame:
    """Result lists without too much of one kind: key, tie, rank.

    A list is gone through in order of score; once `most` of a kind are kept, a further one is kept only if its score
    plus 20 x factor reaches 0.8 of that of the last row kept. The fold needs a list in one place: `rows` are result
    lists, of at most the k that a search returned. Nulls of the kind are one kind.
    """
    row = F.struct((-F.col(score)).alias("neg"), F.col(tie).alias("id"), F.coalesce(F.col(kind), F.lit("unknown")).alias("kind"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("list"))

    def step(kept: Column, x: Column) -> Column:
        full = F.size(F.filter(kept, lambda y: y["kind"] == x["kind"])) >= most
        weak = -x["neg"] + 20 * factor < 0.8 * -F.element_at(kept, -1)["neg"]
        return F.when((F.size(kept) > 0) & full & weak, kept).otherwise(F.concat(kept, F.array(x)))

    none = F.filter("list", lambda x: F.lit(False))
    kept = lists.select(key, F.posexplode(F.aggregate("list", none, step)).alias("rank", "r"))
    return kept.select(key, F.col("r.id").alias(tie), (F.col("rank") + 1).alias("rank"))


def retrieval_plan(
    pool: DataFrame, spare: DataFrame, row_id: str, kind: str, score: str, k: int, within_budget: Column, fit: Column, relevance: Column
) -> DataFrame:
    """The k rows of a whole retrieval: row_id, kind, relevance, rank.

    Broad: the 3k best of `pool` by `score`; where fewer than max(5, k / 4) came out, the 2k best of `spare` that aren't
    among them are added. Then k rows in turns over kinds, those within the budget, and an order by the blend of 0.7
    relevance and 0.3 fit. Only lists of a few k rows are ever ordered in one place.
    """
    broad = pool.orderBy(F.desc(score), row_id).limit(3 * k)
    enough = broad.agg((F.count("*") >= max(5, k // 4)).alias("_enough"))
    extra = spare.join(broad.select(row_id), row_id, "left_anti").orderBy(F.desc(score), row_id).limit(2 * k)
    extra = extra.join(F.broadcast(enough)).where("not _enough").drop("_enough")
    picked = per_kind_quota(broad.unionByName(extra), kind, score, row_id, k).where(within_budget)
    ranked = picked.select(row_id, kind, F.round(0.7 * relevance + 0.3 * fit, 6).alias("relevance"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("relevance"), row_id))).where(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) in an order, each row with the total number of rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def seeded_sample(rows: DataFrame, row_id: str, n: int, seed: str) -> DataFrame:
    """n rows chosen by hash of the seed and the id: the same rows wherever and however often it runs."""
    place = F.md5(F.concat(F.lit(seed + ":"), F.col(row_id).cast("string")))
    return rows.orderBy(place, row_id).limit(n)
