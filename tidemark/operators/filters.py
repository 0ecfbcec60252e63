"""Predicates as data: rule chains, warnings, registry matches, audits, pages, ordered concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that holds; the order of the rules matters."""
    chain = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        chain = chain.when(test, name)
    return chain.otherwise(otherwise)


def warnings(checks: dict[str, Column]) -> Column:
    """Array of the names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))


def match_registry(rows: DataFrame, registry: DataFrame, row_id: str, name: str, kind: str) -> DataFrame:
    """First hit of a row's name among names, then among aliases, of the same kind: row_id, entity_no, method."""
    names = registry.groupBy(F.lower(F.trim("canonical_name")).alias("k"), F.col("entity_type").alias("t")).agg(F.min("entity_no").alias("by_name"))
    alias = registry.select(F.explode("aliases").alias("a"), F.col("entity_type").alias("t"), "entity_no").where("a is not null")
    alias = alias.groupBy(F.lower(F.trim("a")).alias("k"), "t").agg(F.min("entity_no").alias("by_alias"))
    out = rows.withColumns({"k": F.lower(F.trim(name)), "t": F.col(kind)}).join(names, ["k", "t"], "left").join(alias, ["k", "t"], "left")
    method = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return out.select(row_id, F.coalesce("by_name", "by_alias").alias("entity_no"), method.alias("method"))


def audit(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Counts of keys that are missing, extra or correct, in one full outer join."""
    key = expected.columns[0]
    a = expected.distinct().withColumn("_a", F.lit(1))
    b = present.distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("correct")
    )
    return both.unpivot([], ["missing", "extra", "correct"], "part", "n")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in order, with the number of pages; only the rows up to the page are sorted."""
    pages = rows.agg(F.ceil(F.count("*") / float(size)).alias("pages"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(pages))


def ordered_text(rows: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """Texts of each key in order as one digest, with their number and length; repeated positions count once."""
    once = rows.where(F.col(text).isNotNull()).groupBy(key, position).agg(F.min(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "t"))), lambda x: x["t"]), " ")
    return once.groupBy(key).agg(F.count("*").alias("segments"), F.md5(joined).alias("digest"), F.sum(F.length("t")).alias("chars"))


# Kinds of entity and the words in a name that tell them.
KINDS = ["attraction", "restaurant", "hotel", "activity", "shopping", "transportation"]
KIND_WORDS = [("hotel", ["hotel", "guesthouse"]), ("restaurant", ["restaurant", "kitchen"]), ("shopping", ["bazaar", "market"]), ("attraction", ["temple", "palace"])]


def entity_kind(kind: Column, name: Column) -> Column:
    """A valid kind as it is, else what the name tells, else 'unknown'."""
    rules = [(k, contains_any(F.lower(name), words)) for k, words in KIND_WORDS]
    return F.when(F.lower(kind).isin(KINDS), F.lower(kind)).otherwise(first_rule(rules, "unknown"))


def constrained(rows: DataFrame, name: Column, kind: Column, score: Column, include: list[str], avoid: list[str]) -> DataFrame:
    """Rows whose name and kind hold nothing to avoid; what must be included gains 0.3, up to 1."""
    out = reduce(lambda df, word: df.where(~(name.contains(word) | kind.contains(word))), avoid, rows)
    return out.withColumn("score", F.least(F.lit(1.0), score + F.when(contains_any(name, include), 0.3).otherwise(0.0)))


def latest(rows: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")
