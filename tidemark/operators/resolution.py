"""Resolution in tiers: exact, near, near and verified, by meaning; with a trail of what decided each link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import ratio_udf
from tidemark.functions.text import signature
from tidemark.operators import pairs
from tidemark.session import cut_lineage

#: A hook that takes pairs (a, b, score) and returns those it could judge with verdict (boolean) and confidence.
Verifier = Callable[[DataFrame], DataFrame]
#: Confidence that a verdict must have, and kinds that may be one thing (fixed values).
SURE = 0.7
COMPATIBLE = {"destination": "sight", "attraction": "sight", "restaurant": "food", "shopping": "food"}


def verified(candidates: DataFrame, verify: Verifier) -> DataFrame:
    """Candidates that the verifier confirms with enough confidence; those it failed on are no matches."""
    return verify(candidates).where(F.col("verdict") & (F.col("confidence") >= SURE)).select("a", "b", "score", "confidence")


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")), " ")


def in_group_matches(rows: DataFrame, group: str, kind: str, name: str, place: str, threshold: float = 0.75) -> DataFrame:
    """Pairs of entities of one group (a video) of compatible kinds whose weighted similarity reaches the threshold.

    Similarity: 0.7 of the name's (token-sorted indel ratio, 0.85 at least where one name holds the other) and 0.3 of the
    place's (the same with 0.9; 1 where both are missing, 0.8 where one is). Equal entities of a group are compared once.
    A pair is scored in Python only if its letters allow the threshold: the ratio can't exceed twice the letters in
    common over both lengths. Blank names match nothing. Columns: group, a, b (names), a_place, b_place, score.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    of = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in COMPATIBLE.items()], F.col(kind), F.lit(""))
    e = rows.select(F.col(group).alias("g"), of.alias("kind"), low(name).alias("a"), low(place).alias("p")).where("a <> ''").distinct()
    letters = lambda c: F.transform(F.split(F.col(c), ""), lambda x, i: F.concat(x, F.size(F.filter(F.slice(F.split(F.col(c), ""), 1, i + 1), lambda y: y == x)).cast("string")))
    e = e.withColumns({"s": token_sorted(F.col("a")), "ps": token_sorted(F.col("p"))}).withColumn("l", letters("s"))
    f = e.withColumnsRenamed({"a": "b", "p": "q", "s": "t", "ps": "qs", "l": "m"})
    both = e.join(f, ["g", "kind"]).where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("p") < F.col("q"))))
    holds = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    most = 2 * F.size(F.array_intersect("l", "m")) / (F.length("s") + F.length("t"))
    both = both.where(holds | (0.7 * most + 0.3 >= threshold))
    ratio = ratio_udf("indel")
    name_sim = F.greatest(ratio("s", "t"), F.when(holds, 0.85).otherwise(0.0))
    held = F.col("p").contains(F.col("q")) | F.col("q").contains(F.col("p"))
    place_sim = (
        F.when((F.col("p") == "") & (F.col("q") == ""), 1.0).when((F.col("p") == "") | (F.col("q") == ""), 0.8)
        .otherwise(F.greatest(ratio("ps", "qs"), F.when(held, 0.9).otherwise(0.0)))
    )
    scored = both.withColumn("score", F.round(0.7 * name_sim + 0.3 * place_sim, 6)).where(F.col("score") >= threshold)
    return scored.select(F.col("g").alias(group), "a", "b", F.col("p").alias("a_place"), F.col("q").alias("b_place"), "score")


def entity_tiers(
    rows: DataFrame, row_id: str, block: list[str], name: str, vector: str, verify: Verifier, auto: float = 0.9, near: float = 0.8, meaning: float = 0.87
) -> DataFrame:
    """Trail of links between entities: a, b, tier, method, score, confidence. Each tier sees only what is unmatched so far.

    Tier 1: equal normal forms (each row linked with the first of its form). Tier 2: fuzzy names from `auto` on. Tier 3:
    fuzzy from `near` on, verified. Tier 4: cosine of vectors from `meaning` on inside the block, verified. Null and
    blank names are in no tier but the fourth; null vectors not in that.
    """
    base = rows.select(F.col(row_id).alias("id"), *block, F.col(name).alias("name"), F.col(vector).alias("v"))
    form = signature(*[F.col(c) for c in block], F.col("name"))
    named = base.where(F.length(F.trim("name")) > 0).withColumn("form", form)
    first = named.groupBy("form").agg(F.min("id").alias("first"))
    exact = named.join(first, "form").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    exact = cut_lineage(exact.select("a", "b", F.lit(1).alias("tier"), F.lit("exact").alias("method"), F.lit(1.0).alias("score"), F.lit(1.0).alias("confidence")))

    lead = cut_lineage(named.join(exact.select(F.col("b").alias("id")), "id", "left_anti").withColumn("low", F.lower(F.trim("name"))))
    found = pairs.fuzzy_pairs(lead, block, "low", near)
    keys = lambda side, other: lead.select(*[F.col(c).alias(f"_{c}") for c in block], F.col("low").alias(side), F.col("id").alias(other))
    for side, other in (("a", "_a"), ("b", "_b")):
        on = F.lit(True)
        k = keys(f"_{side}_name", other)
        for c in block:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = found.join(k, on & (F.col(side) == F.col(f"_{side}_name"))).drop(*[f"_{c}" for c in block], f"_{side}_name")
    found = cut_lineage(found.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "score"))
    sure = found.where(F.col("score") >= auto).select("a", "b", F.lit(2).alias("tier"), F.lit("fuzzy").alias("method"), "score", F.col("score").alias("confidence"))
    gone = sure.select(F.col("b").alias("id")).distinct()
    maybe = found.where(F.col("score") < auto).join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
    told = verified(maybe.select("a", "b", "score"), verify).select("a", "b", F.lit(3).alias("tier"), F.lit("fuzzy verified").alias("method"), "score", "confidence")
    so_far = cut_lineage(exact.unionByName(sure).unionByName(told))
    free = base.join(so_far.select(F.col("b").alias("id")).distinct(), "id", "left_anti").withColumn("block", F.concat_ws("||", *[F.coalesce(c, F.lit("")) for c in block]))
    alike = pairs.semantic(free, "block", "id", "v", meaning).withColumnRenamed("similarity", "score")
    last = verified(alike, verify).select("a", "b", F.lit(4).alias("tier"), F.lit("meaning verified").alias("method"), "score", "confidence")
    return so_far.unionByName(last)


def insight_tiers(rows: DataFrame, row_id: str, block: str, form: Column, vector: str, verify: Verifier, auto: float, near: float) -> DataFrame:
    """Group of every insight by its smallest id: row_id, component. Equal forms, then vectors from `auto` on, then from `near` on if verified.

    Unlike entities, groups that a later tier links become one.
    """
    base = cut_lineage(rows.select(F.col(row_id).cast("long").alias("id"), F.col(block).alias("g"), form.alias("form"), F.col(vector).alias("v")))
    first = base.groupBy("form").agg(F.min("id").alias("a"))
    exact = base.join(first, "form").where("id <> a").select("a", F.col("id").alias("b"))
    found = cut_lineage(pairs.semantic(base, "g", "id", "v", near).withColumnRenamed("similarity", "score"))
    edges = exact.unionByName(found.where(F.col("score") >= auto).select("a", "b")).unionByName(verified(found.where(F.col("score") < auto), verify).select("a", "b"))
    return pairs.components(base.select("id"), edges).withColumnRenamed("id", row_id)
