"""Incremental, stateful and quality queries, context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import filters, incremental
from tidemark.plans.catalog import register
from tidemark.session import table

_OP = "case event_type when 'signup' then 'register' when 'view' then 'start' when 'click' then 'start' when 'purchase' then 'complete' else 'fail' end"


def _ops(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t == "signup", "register").when(t.isin("view", "click"), "start").when(t == "purchase", "complete").otherwise("fail")
    return table(spark, d, "events").select("user_id", op.alias("op"), "ts", "event_id")


_MACHINE = f"""(with e as (select user_id, {_OP} as op, ts, event_id from events), l as (select *, lag(op) over (partition by user_id order by ts, event_id) as b from e)
select user_id, case arg_max(op, (ts, event_id)) when 'complete' then 'complete' when 'fail' then 'failed' when 'start' then 'processing' else 'pending' end as status, count(*) filter (op = 'start') as starts, count(*) filter (op = 'fail') as fails,
count(*) filter (op = 'fail' or (op = 'start' and b = 'fail')) as retry_count from l group by 1)"""


@register(f"from {_MACHINE}")
def stage_machine(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replay(_ops(spark, d), "user_id", "op", "ts", "event_id")


@register("""with o as (select o_custkey as k, o_totalprice as p, o_orderdate as t, o_orderstatus as s, o_orderkey as i, o_orderdate >= timestamp '1996-01-01' as n from orders), g as (select k, n, sum(p) as p, max(t) as t, arg_max(s, (t, i)) as s from o group by all)
select k as c_key, round(sum(p), 4) as total, arg_max(s, (t, n)) as last_status, max(t) as last_at, case when count(*) = 2 then 'merged' when bool_and(n) then 'created' else 'untouched' end as status from g group by 1""")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    part = lambda rows: rows.groupBy(F.col("o_custkey").alias("c_key")).agg(F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("last_at"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    new = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    out = incremental.merge(part(o.where(~new)), part(o.where(new)), "c_key", ["total"], ["last_status"], "last_at")
    return out.select("c_key", F.round("total", 4).alias("total"), "last_status", "last_at", "status")


@register("""with s as (select distinct on (record_id) * from canonical_snapshots) select group_id, arg_max(run_id, (coalesce(updated_at, timestamp '1970-01-01'), record_id)) as last_run, count(distinct run_id) as runs, max(total_mentions) as mentions, arg_max(geocoding_source, (geocoding_confidence, record_id)) filter (geocoding_confidence is not null) as best_geo from s group by 1""")
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"])
    geo = F.when(F.col("geocoding_confidence").isNotNull(), F.struct("geocoding_confidence", "record_id"))
    return s.groupBy("group_id").agg(
        F.max_by("run_id", F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp_ntz")), "record_id")).alias("last_run"), F.countDistinct("run_id").alias("runs"), F.max("total_mentions").alias("mentions"),
        F.max_by("geocoding_source", geo).alias("best_geo"),
    )


@register("""with r as (select entity_no, confidence_score, row_number() over (order by total_mentions desc, entity_no) as pos from canonical_entities) select entity_no, pos <= 40 as enriched, round(least(0.95, confidence_score + case when pos <= 40 then 0.15 else 0 end), 6) as confidence from r""")
def capped_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_entities")
    top = c.orderBy(F.desc("total_mentions"), "entity_no").limit(40).select("entity_no", F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    return c.join(top, "entity_no", "left").select("entity_no", hit.alias("enriched"), F.round(F.least(F.lit(0.95), F.col("confidence_score") + F.when(hit, 0.15).otherwise(0.0)), 6).alias("confidence"))


_ISSUES = """(select l_orderkey, l_linenumber, unnest([case when l_quantity > 45 then 'over_limit' end, case when l_discount > 0.08 then 'high_discount' end, case when l_tax = 0 then 'no_tax' end]) as issue from lineitem)"""


@register(f"select l_orderkey, l_linenumber, issue from {_ISSUES} where issue is not null")
def issue_rows(spark: SparkSession, d: str) -> DataFrame:
    checks = {"over_limit": F.col("l_quantity") > 45, "high_discount": F.col("l_discount") > 0.08, "no_tax": F.col("l_tax") == 0}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(filters.warnings(checks)).alias("issue"))


@register(f"""select l_orderkey, count(issue) as issues, round(greatest(0, 1 - sum(case issue when 'over_limit' then 0.15 when 'high_discount' then 0.05 when 'no_tax' then 0.01 else 0 end)), 6)::double as score, bool_or(coalesce(issue = 'over_limit', false)) as regenerate from {_ISSUES} group by 1""")
def validation_score(spark: SparkSession, d: str) -> DataFrame:
    big, cut, free = F.col("l_quantity") > 45, F.col("l_discount") > 0.08, F.col("l_tax") == 0
    n = sum((c.cast("int") for c in (big, cut, free)), F.lit(0))
    penalty = big.cast("int") * 0.15 + cut.cast("int") * 0.05 + free.cast("int") * 0.01
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(n).alias("issues"), F.round(F.greatest(F.lit(0.0), 1 - F.sum(penalty)), 6).alias("score"), F.bool_or(big).alias("regenerate")
    )


@register("""select 'rows' as metric, count(*)::double as value from extracted_entities union all select 'no_name', count(*) filter (coalesce(trim(entity_name), '') = '') from extracted_entities union all select 'no_place', count(*) filter (city is null and country is null and location is null) from extracted_entities
union all select 'unique_name_ratio', round(count(distinct entity_name) / count(*), 6) from extracted_entities""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").agg(
        F.count("*").cast("double").alias("rows"), F.count_if(F.coalesce(F.trim("entity_name"), F.lit("")) == "").cast("double").alias("no_name"),
        F.count_if(F.col("city").isNull() & F.col("country").isNull() & F.col("location").isNull()).cast("double").alias("no_place"),
        F.round(F.countDistinct("entity_name") / F.count("*"), 6).alias("unique_name_ratio"),
    )
    return rows.unpivot([], rows.columns, "metric", "value")


@register("""select group_id, count(*) as records, round(count(distinct canonical_name) / count(*), 6) as unique_ratio, count(distinct canonical_name) / count(*) > 0.7 as suspicious from (select distinct on (record_id) * from canonical_snapshots) group by 1""")
def over_merge(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.countDistinct("canonical_name") / F.count("*")
    return table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"]).groupBy("group_id").agg(F.count("*").alias("records"), F.round(ratio, 6).alias("unique_ratio"), (ratio > 0.7).alias("suspicious"))


@register("""with g as (select count(*) as n, count(latitude) as g, count(*) filter (total_mentions > 1) as m from canonical_entities) select round(g / n, 6) as geocoded, case when g / n < 0.5 then 'fail' else 'pass' end as geocode_gate, case when m / n < 0.1 then 'fail' else 'pass' end as ratio_gate from g""")
def run_gates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "canonical_entities").agg((F.count("latitude") / F.count("*")).alias("g"), (F.count_if(F.col("total_mentions") > 1) / F.count("*")).alias("m"))
    return g.select(F.round("g", 6).alias("geocoded"), F.when(F.col("g") < 0.5, "fail").otherwise("pass").alias("geocode_gate"), F.when(F.col("m") < 0.1, "fail").otherwise("pass").alias("ratio_gate"))


@register("""with r as (select city, canonical_name, row_number() over (partition by city order by total_mentions desc, entity_no) as pos from canonical_entities where city is not null) select city, canonical_name, case when pos <= 5 then 1 when pos <= 10 then 2 else 3 end as tier from r where pos <= 15""")
def context_tiers(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("total_mentions"), "entity_no"))
    rows = table(spark, d, "canonical_entities").where("city is not null").withColumn("at", at).where("at <= 15")
    return rows.select("city", "canonical_name", F.when(F.col("at") <= 5, 1).when(F.col("at") <= 10, 2).otherwise(3).alias("tier"))


_GRAPH = "(select distinct 'video:' || video_id as a, 'place:' || city as b from extracted_entities where city is not null and trim(city) <> '' and video_id is not null)"


@register(f"select a as node, count(*) as degree from (select a, b from {_GRAPH} union all select b, a from {_GRAPH}) group by 1")
def knowledge_graph(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").where("city is not null and trim(city) <> '' and video_id is not null")
    edges = rows.select(F.concat(F.lit("video:"), "video_id").alias("a"), F.concat(F.lit("place:"), "city").alias("b")).distinct()
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


@register("""with v as (select video_id, max(duration_seconds) as s from videos group by 1), e as (select video_id, count(distinct entity_name) as n from extracted_entities group by 1) select video_id, n as entities, round(60.0 * n / s, 6) as per_minute from v join e using (video_id) where s > 0""")
def content_richness(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").groupBy("video_id").agg(F.max("duration_seconds").alias("s")).where("s > 0")
    e = table(spark, d, "extracted_entities").groupBy("video_id").agg(F.countDistinct("entity_name").alias("entities"))
    return v.join(e, "video_id").select("video_id", "entities", F.round(60.0 * F.col("entities") / F.col("s"), 6).alias("per_minute"))


@register("""select o_orderpriority, approx_count_distinct(o_custkey) > 0 as seen, count(distinct o_custkey) as customers from orders group by 1""")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg((F.approx_count_distinct("o_custkey") > 0).alias("seen"), F.countDistinct("o_custkey").alias("customers"))


@register("""with k as (select distinct user_id from events) , a as (select event_id, user_id, ts from events where event_type = 'purchase'), b as (select user_id, ts, event_id, value from events where event_type = 'view')
select a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) as view_id from a left join b on a.user_id = b.user_id and b.ts <= a.ts group by 1""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the last view of its user up to then: one ordered pass per user, no join of all pairs."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view"))
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True)
    # at equal times views come first, the larger id last
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("view_id", seen.over(w)).where("event_type = 'purchase'").select("event_id", "view_id")
