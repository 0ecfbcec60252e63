"""Problem 8: a mix of sources at target weights.

Method: weighted fair queueing. The documents of a source are shuffled by a hash, every pass over the source after the
one before, and a document's virtual finish time is the source's running sum of tokens divided by its weight. The mix
is the documents in order of finish time, cut where the total of tokens reaches the budget. Running sums are taken in
two steps (sums of small ordered slots, then inside a slot), so no source and no moment is one task's whole load.

Defined results: null sources, sources without a target and documents without tokens are not part of the mix; targets
are scaled to add up to 1 over the sources that have tokens, the others are reported with share 0; ties in the hash
go to the smaller doc_id; the default budget is the largest total at which every source can still fill its share
within its max_repeats. A repeated doc_id is one document (its first row by text). Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKENIZERS, token_count
from tidemark.session import materialize

#: Rows of one slot (about), and the least slots: the hash range of a source and the time range of the mix are cut into
#: as many slots as their rows need, so the rows of a task don't grow with the data.
SLOT_ROWS, LEAST_SLOTS = 20_000, 16


def running_sum(df: DataFrame, value: str, key: list[str], slot: Column, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, the sum of `value` up to each row within `key` in order of (slot, order).

    `slot` is a number that never falls in that order; only the rows of one slot meet in one task.
    """
    df = df.withColumn("_slot", slot)
    sums = df.groupBy(*key, "_slot").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumn("_inside", F.sum(value).over(inside))
    return within.join(sums, [*key, "_slot"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_slot", "_before", "_inside")


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Documents of the target sources with their tokens, as a written table: doc_id, source, tokens, place (hash)."""
    known = targets.where("target_share > 0").select("source").distinct()
    rows = documents.select("doc_id", "source", "text").join(F.broadcast(known), "source", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("r")).select("doc_id", "r.source", token_count("r.text", tokenizer, folder).alias("tokens"))
    place = F.shiftright(F.xxhash64("doc_id", F.lit("mix")), 24)  # 40 bits with sign
    return materialize(rows.where("tokens > 0").withColumn("place", place), "sized")


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target source: target_share (scaled), max_repeats, available tokens, and the budget they allow."""
    have = documents.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").fillna(0, ["available", "documents", "target_share"]).fillna(1, ["max_repeats"])
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("weight", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(every)))
    return t.withColumn("feasible", F.min(F.col("available") * F.col("max_repeats") / F.col("weight")).over(every))


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The mix in order: source, doc_id, pass (from 1), tokens, finish (virtual time), total (running tokens)."""
    docs = sized(documents, targets, tokenizer, folder)
    return _mixed(docs, plan(docs, targets), budget)


def _slots(rows: int) -> int:
    return max(LEAST_SLOTS, -(-rows // SLOT_ROWS))


def _mixed(docs: DataFrame, plan_: DataFrame, budget: float | None) -> DataFrame:
    limit = F.lit(float(budget)) if budget is not None else F.col("feasible")
    weights = F.broadcast(plan_.where("weight is not null").select("source", "weight", "available", "max_repeats", limit.alias("budget")))
    largest = plan_.agg(F.max("documents")).first()[0] or 0
    slots = _slots(largest)
    slot = F.floor((F.col("place") + F.lit(2**39)) / F.lit(2.0**40) * slots)
    once = running_sum(docs, "tokens", ["source"], slot, ["place", "doc_id"], "used").join(weights, "source")
    # every pass goes through the source in the same order: a document's sum in pass p is p - 1 whole passes more
    passes = F.least(F.col("max_repeats"), F.floor((F.col("weight") * F.col("budget") - F.col("used")) / F.col("available")) + 1).cast("int")
    rows = once.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    rows = rows.withColumn("used", F.col("used") + (F.col("pass") - 1) * F.col("available"))
    rows = rows.withColumn("finish", F.col("used") / F.col("weight")).where(F.col("finish") <= F.col("budget"))
    expected = plan_.agg(F.sum(F.col("documents") * F.col("max_repeats"))).first()[0] or 0
    moment = F.floor(F.col("finish") / F.col("budget") * _slots(expected))
    rows = running_sum(rows.withColumn("_all", F.lit(1)), "tokens", ["_all"], moment, ["finish", "source", "doc_id", "pass"], "total")
    return rows.where(F.col("total") <= F.col("budget")).select("source", "doc_id", "pass", "tokens", "finish", "total")


def shares(documents: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Report of a mix: source, target_share, actual_share, tokens, documents, repeats (most uses of one document)."""
    docs = sized(documents, targets, tokenizer, folder)
    plan_ = plan(docs, targets)
    used = _mixed(docs, plan_, budget).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.countDistinct("doc_id").alias("documents"), F.max("pass").alias("repeats")
    )
    out = plan_.select("source", "target_share", "max_repeats").join(used, "source", "left").fillna(0)
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)))
