"""Merge, state, cache and insight queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import merging, scores
from tidemark.plans.catalog import register
from tidemark.session import table

_ORDER = "(coalesce(updated_at, timestamp '1970-01-01'), record_id)"
_TWO = f"""s as (select distinct on (record_id) * from canonical_snapshots), p as (select group_id, min({_ORDER}) as lo, max({_ORDER}) as hi from s group by 1),
o as (select s.* from s join p on s.group_id = p.group_id and {_ORDER} = lo), n as (select s.* from s join p on s.group_id = p.group_id and {_ORDER} = hi and lo <> hi)"""


def _old_and_new(spark: SparkSession, d: str) -> DataFrame:
    """The oldest and the newest record of each group that has two, as structs."""
    s = table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"])
    order = F.struct(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp_ntz")), "record_id")
    whole = F.struct(*[c for c in s.columns if c != "group_id"])
    g = s.groupBy("group_id").agg(F.min_by(whole, order).alias("o"), F.max_by(whole, order).alias("n"))
    return g.where("o.record_id <> n.record_id")


_SORTED = "list_sort(list_filter(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, []))), lambda x: x is not null))"
_BOTH = "list_filter(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])), lambda x: x is not null)"
_ONCE = f"list_filter({_BOTH}, lambda x, i: list_position(list_transform({_BOTH}, lambda y: lower(y)), lower(x)) = i)"


@register(f"with {_TWO} select group_id, array_to_string({_SORTED}, '|') as every, array_to_string({_ONCE}, '|') as ordered, array_to_string(list_slice({_ONCE}, 1, 5), '|') as five from o join n using (group_id)")
def list_unions(spark: SparkSession, d: str) -> DataFrame:
    """The aliases of a group's oldest and newest record: sorted union, union in order whatever the case, five of it."""
    g, o, n = _old_and_new(spark, d), F.col("o.aliases"), F.col("n.aliases")
    return g.select(
        "group_id", F.array_join(merging.union_sorted(o, n), "|").alias("every"), F.array_join(merging.union_ordered(o, n), "|").alias("ordered"),
        F.array_join(merging.union_ordered(o, n, 5), "|").alias("five"),
    )


_NORM = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', '')"


@register(f"""with {_TWO}, j as (select o.group_id, coalesce(o.canonical_name, n.canonical_name) as name, o.aliases as oa, n.aliases as na, o.latitude as ola, o.geocoding_confidence as oc, n.latitude as nla, n.geocoding_confidence as nc, o.confidence_score as os, n.confidence_score as ns,
o.total_mentions as om, n.total_mentions as nm, o.entity_type as ot, n.entity_type as nt from o join n using (group_id)),
f as (select *, list_filter(list_distinct(list_filter(list_concat(coalesce(oa, []), coalesce(na, [])), lambda x: x is not null)), lambda a: {_NORM.format('a')} <> '' and {_NORM.format('a')} <> coalesce({_NORM.format('name')}, '')) as aliases from j)
select group_id, array_to_string(list_sort(aliases), '|') as aliases, case when nla is not null and (ola is null or coalesce(nc, 0) > coalesce(oc, 0)) then nla when ola is not null then ola end as latitude,
case when os is not null or ns is not null then round((coalesce(os, 0.5) + coalesce(ns, 0.5)) / 2 + 1e-9, 3) end as confidence, coalesce(om, 0) + coalesce(nm, 0) as mentions, case when length(trim(ot)) > 0 and lower(trim(ot)) <> 'unknown' then ot else coalesce(nt, ot) end as entity_type from f""")
def field_merge(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of a group merged into the oldest, each field by its own rule."""
    g = _old_and_new(spark, d)
    point = lambda c: F.struct(F.col(f"{c}.latitude").alias("latitude"), F.col(f"{c}.longitude").alias("longitude"), F.col(f"{c}.geocoding_confidence").alias("confidence"))
    name = F.coalesce("o.canonical_name", "n.canonical_name")
    return g.select(
        "group_id", F.array_join(merging.merge_aliases(F.col("o.aliases"), F.col("n.aliases"), name), "|").alias("aliases"), merging.better_point(point("o"), point("n"))["latitude"].alias("latitude"),
        merging.mean_confidence(F.col("o.confidence_score"), F.col("n.confidence_score")).alias("confidence"), (F.coalesce("o.total_mentions", F.lit(0)) + F.coalesce("n.total_mentions", F.lit(0))).alias("mentions"),
        merging.first_known(F.col("o.entity_type"), F.col("n.entity_type")).alias("entity_type"),
    )


_AS_OF = "timestamp '2026-01-01'"


@register(f"""with s as (select distinct on (record_id) * from canonical_snapshots), g as (select group_id, sum(coalesce(total_mentions, 0)) as m, count(distinct run_id) as v, max(updated_at) as t from s group by 1), a as (select *, date_diff('day', t, {_AS_OF}) as days from g)
select group_id, round(0.6 * least(1.0, m / 20) + 0.4 * least(1.0, v / 10), 3)::double as popularity, case when days is null then 0.5 when days <= 30 then 1.0 when days <= 90 then 0.8 when days <= 180 then 0.6 when days <= 365 then 0.4 else 0.2 end::double as freshness from a""")
def rescored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of merged groups worked out anew from all their records."""
    s = table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"])
    g = s.groupBy("group_id").agg(F.sum(F.coalesce("total_mentions", F.lit(0))).alias("m"), F.countDistinct("run_id").alias("v"), F.max("updated_at").alias("t"))
    days = F.datediff(F.lit("2026-01-01").cast("date"), F.col("t").cast("date"))
    return g.select("group_id", scores.popularity(F.col("m"), F.col("v")).alias("popularity"), scores.freshness(days).alias("freshness"))


@register("""with k as (select lower(trim(canonical_name)) as name, coalesce(city, '') as city, entity_no, total_mentions as n, row_number() over (partition by lower(trim(canonical_name)), coalesce(city, '') order by entity_no) as first from canonical_entities),
o as (select lower(trim(entity_name)) as name, coalesce(city, '') as city, count(*) as n from (select distinct on (intake_id) * from entity_intake) where entity_name is not null group by 1, 2)
select coalesce(k.name, o.name) as name, coalesce(k.city, o.city) as city, entity_no, coalesce(k.n, 0) + coalesce(o.n, 0) as mentions, case when entity_no is null then 'created' when o.n is null then 'untouched' else 'merged' end as status
from k full join o on k.name = o.name and k.city = o.city and k.first = 1""")
def match_or_create(spark: SparkSession, d: str) -> DataFrame:
    """The intake merged into the registry by name and city; what nothing matches is created, what is not offered stays."""
    known = table(spark, d, "canonical_entities").select(F.lower(F.trim("canonical_name")).alias("name"), F.coalesce("city", F.lit("")).alias("city"), "entity_no", F.col("total_mentions").cast("long").alias("mentions"))
    offered = table(spark, d, "entity_intake").dropDuplicates(["intake_id"]).where("entity_name is not null")
    offered = offered.select(F.lower(F.trim("entity_name")).alias("name"), F.coalesce("city", F.lit("")).alias("city"), F.lit(1).cast("long").alias("mentions"))
    return merging.match_or_create(known, offered, ["name", "city"], "entity_no", ["mentions"])


_OPS = "select user_id, 1 + (event_id % 3)::int as stage, case event_type when 'signup' then 'register' when 'view' then 'start' when 'click' then 'start' when 'purchase' then 'complete' when 'logout' then 'reset' else 'fail' end as op, ts, event_id from events"
_STATES = f"""e as ({_OPS}), l as (select *, lag(op) over w as b, count(*) filter (op = 'reset') over (partition by user_id, stage order by ts, event_id) as era, last_value(case when op = 'start' then ts end ignore nulls) over (partition by user_id, stage order by ts, event_id) as s from e window w as (partition by user_id, stage order by ts, event_id)),
g as (select user_id, stage, era, count(*) filter (op = 'fail' or (op = 'start' and b = 'fail')) as r, sum(case when op = 'complete' and b = 'start' then epoch(ts)::bigint - epoch(s)::bigint end) as took, max((ts, event_id)) as m, arg_max(op, (ts, event_id)) as op from l group by 1, 2, 3),
st as (select user_id, stage, case arg_max(op, m) when 'complete' then 'complete' when 'fail' then 'failed' when 'start' then 'processing' else 'pending' end as status, arg_max(r, era) as retry_count, coalesce(sum(took), 0)::bigint as seconds from g group by 1, 2)"""


def _stage_ops(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t == "signup", "register").when(t.isin("view", "click"), "start").when(t == "purchase", "complete").when(t == "logout", "reset").otherwise("fail")
    return table(spark, d, "events").select("user_id", (1 + F.col("event_id") % 3).cast("int").alias("stage"), op.alias("op"), "ts", "event_id")


@register(f"with {_STATES.replace('epoch(ts)::bigint', 'floor(epoch(ts))::bigint').replace('epoch(s)::bigint', 'floor(epoch(s))::bigint')} from st")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    """Status, retries and seconds of work of every stage of every key."""
    return merging.stage_states(_stage_ops(spark, d), "user_id", "stage", "op", "ts", "event_id")


@register(f"with {_STATES} select a.user_id, a.stage, a.status, a.retry_count from st a left join st b on a.user_id = b.user_id and a.stage = b.stage + 1 and b.status = 'complete' where a.status in ('pending', 'failed') and a.retry_count < 3 and (a.stage = 1 or b.user_id is not null)")
def pending_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages due: not complete, fewer than three retries, the stage before complete."""
    return merging.pending_stages(stage_durations(spark, d), "user_id", "stage").select("user_id", "stage", "status", "retry_count")


@register("with c as (select md5(event_type || '|' || (event_id % 50)::varchar) as key, max(ts) as ts from events group by 1), n as (select max(ts) as now from events) select key, ts from c, n where floor(epoch(now)) - floor(epoch(ts)) <= 3600")
def fresh_results(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers by md5 of the query and its arguments that are an hour old at most."""
    e = table(spark, d, "events")
    cache = e.select(F.md5(F.concat_ws("|", "event_type", (F.col("event_id") % 50).cast("string"))).alias("key"), "ts")
    now = e.agg(F.max("ts").alias("now"))
    rows = cache.groupBy("key").agg(F.max("ts").alias("ts")).join(F.broadcast(now))
    return merging.fresh_results(rows, "key", "ts", F.lit(e.agg(F.max("ts")).first()[0])).select("key", "ts")


@register("""with e as (select distinct on (mention_id) * from extracted_entities), k as (select canonical_name as name, min(entity_no) as no from canonical_entities where latitude is not null group by 1), p as (select city as name, min(place_id) as no from places where kind = 'city' group by 1),
w as (select coalesce(entity_name, '') as name, count(*) as n from e group by 1) select name, n as mentions, coalesce(k.no, p.no) as point, case when k.no is not null then 'cache' when p.no is not null then 'asked' else 'nowhere' end as found_in from w left join k using (name) left join p using (name)""")
def geocode_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names located by the cache of known entities, the rest by the geocoder (here the list of cities)."""
    e = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    names = e.groupBy(F.coalesce("entity_name", F.lit("")).alias("name")).agg(F.count("*").alias("mentions"))
    cache = table(spark, d, "canonical_entities").where("latitude is not null").groupBy(F.col("canonical_name").alias("name")).agg(F.min("entity_no").alias("point"))
    listed = table(spark, d, "places").where("kind = 'city'").groupBy(F.col("city").alias("name")).agg(F.min("place_id").alias("point"))
    return merging.cached_or_asked(names, cache, ["name"], ["point"], lambda missing: missing.join(listed, "name"))


@register("""with m as (select distinct on (mention_id) * from extracted_entities) select mention_id, case when lower(trim(coalesce(m.city, ''))) not in ('', 'unknown') then m.city else v.city end as city,
case when lower(trim(coalesce(m.city, ''))) not in ('', 'unknown') then 'kept' when v.city is not null then 'filled' else 'missing' end as outcome from m left join (select canonical_name, min(city) as city from canonical_entities where city is not null group by 1) v on v.canonical_name = m.entity_name""")
def filled_cities(spark: SparkSession, d: str) -> DataFrame:
    """The city of each mention, filled from the entity of its name only where it is missing or unknown."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    v = table(spark, d, "canonical_entities").where("city is not null").groupBy(F.col("canonical_name").alias("entity_name")).agg(F.min("city").alias("_city"))
    known = ~F.lower(F.trim(F.coalesce("city", F.lit("")))).isin("", "unknown")
    outcome = F.when(known, "kept").when(F.col("_city").isNotNull(), "filled").otherwise("missing")
    return m.join(v, "entity_name", "left").select("mention_id", F.when(known, F.col("city")).otherwise(F.col("_city")).alias("city"), outcome.alias("outcome"))


_INSIGHT = "md5(concat_ws('||', lower(trim(coalesce(entity_type, ''))), lower(trim(coalesce(city, ''))), lower(trim(coalesce(entity_name, '')))))"


@register(f"""with m as (select distinct on (mention_id) * from extracted_entities), g as (select *, {_INSIGHT} as signature from m where experience is not null),
t as (select signature, array_to_string(list_sort(list(distinct tag)), ',') as tags from (select signature, unnest(tags) as tag from g) where tag is not null group by 1)
select g.signature, count(*) as merged, coalesce(any_value(t.tags), '') as tags, length(arg_max(experience, (length(experience), -mention_id))) as longest, min(extracted_at) as first_at, array_to_string(list_slice(list(mention_id order by mention_id), 1, 3), ',') as merged_from from g left join t using (signature) group by 1""")
def insight_groups(spark: SparkSession, d: str) -> DataFrame:
    """Insights of one signature as one: tags together, the longest details, the first time, where it was merged from."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("experience is not null")
    low = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("entity_type", "city", "entity_name")]
    m = m.withColumn("signature", F.md5(F.concat_ws("||", *low)))
    tags = m.select("signature", F.explode("tags").alias("tag")).where("tag is not null").groupBy("signature").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    # the three smallest ids, found without gathering a hot signature's ids
    first = m.select("signature", "mention_id").withColumn("_k", F.row_number().over(Window.partitionBy("signature").orderBy("mention_id"))).where("_k <= 3")
    origin = first.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("mention_id")), ",").alias("merged_from"))
    g = m.groupBy("signature").agg(F.count("*").alias("merged"), F.max(F.length("experience")).alias("longest"), F.min("extracted_at").alias("first_at"))
    return g.join(tags, "signature", "left").join(origin, "signature").select("signature", "merged", F.coalesce("tags", F.lit("")).alias("tags"), "longest", "first_at", "merged_from")


@register("""with m as (select distinct on (mention_id) * from extracted_entities where true), r as (select coalesce(entity_type, '') as category, case when coalesce(city, '') <> '' then 'city' when coalesce(country, '') <> '' then 'country' else 'none' end as scope, video_id, confidence_score as c from m)
select category, scope, count(*) as insights, count(distinct video_id) as videos, count(*) filter (c >= 0.8) as high, count(*) filter (c >= 0.5 and c < 0.8) as medium, count(*) filter (c < 0.5 or c is null) as low from r group by grouping sets ((category, scope))""")
def insight_stats(spark: SparkSession, d: str) -> DataFrame:
    """Insights by category and scope, with the videos they come from and a histogram of their quality."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    scope = F.when(F.coalesce("city", F.lit("")) != "", "city").when(F.coalesce("country", F.lit("")) != "", "country").otherwise("none")
    c = F.col("confidence_score")
    return m.groupBy(F.coalesce("entity_type", F.lit("")).alias("category"), scope.alias("scope")).agg(
        F.count("*").alias("insights"), F.countDistinct("video_id").alias("videos"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if((c < 0.5) | c.isNull()).alias("low")
    )


@register("""with m as (select distinct on (mention_id) * from extracted_entities) select mention_id, array_to_string(list_filter([case when coalesce(trim(entity_name), '') = '' then 'name_missing' end, case when length(coalesce(experience, '')) < 20 then 'details_short' end,
case when confidence_score is null or confidence_score not between 0 and 1 then 'confidence_invalid' end, case when coalesce(trim(city), '') = '' and coalesce(trim(country), '') = '' then 'scope_missing' end, case when entity_type is null or entity_type = 'unknown' then 'category_invalid' end], lambda x: x is not null), ',') as issues from m""")
def insight_rules(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each insight as it comes out of extraction."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "name_missing": blank("entity_name"), "details_short": F.length(F.coalesce("experience", F.lit(""))) < 20, "confidence_invalid": ~F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False)),
        "scope_missing": blank("city") & blank("country"), "category_invalid": F.col("entity_type").isNull() | (F.col("entity_type") == "unknown"),
    }
    return m.select("mention_id", F.array_join(F.array_compact(F.array(*[F.when(hit, name) for name, hit in rules.items()])), ",").alias("issues"))


@register("""with m as (select distinct on (mention_id) * from extracted_entities), n as (select entity_name, sentiment, count(*) as n from m where entity_name is not null and sentiment is not null group by all), r as (select entity_name, round(max(n) / sum(n), 6)::double as recomputed from n group by 1),
s as (select entity_name, avg(confidence_score) as stored from m where entity_name is not null group by 1) select entity_name, recomputed, round(stored, 6) as stored, abs(recomputed - stored) > 0.1 as off from r join s using (entity_name) where stored is not null""")
def consensus_recheck(spark: SparkSession, d: str) -> DataFrame:
    """The share of the commonest feeling worked out anew beside the stored score, and whether they differ by more than 0.1."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("entity_name is not null")
    n = m.where("sentiment is not null").groupBy("entity_name", "sentiment").agg(F.count("*").alias("n"))
    r = n.groupBy("entity_name").agg(F.round(F.max("n") / F.sum("n"), 6).alias("recomputed"))
    s = m.groupBy("entity_name").agg(F.avg("confidence_score").alias("s")).where("s is not null")
    return r.join(s, "entity_name").select("entity_name", "recomputed", F.round("s", 6).alias("stored"), (F.abs(F.col("recomputed") - F.col("s")) > 0.1).alias("off"))


ADVICE = {"error": "retry later", "logout": "ask again", "purchase": "none"}


@register("select event_type, count(*) as events, case event_type when 'error' then 'retry later' when 'logout' then 'ask again' when 'purchase' then 'none' else 'report' end as advice from events group by 1")
def error_advice(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with the advice of a fixed rule table, 'report' for those without."""
    rules = spark.createDataFrame(list(ADVICE.items()), "event_type string, advice string")
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"))
    return g.join(F.broadcast(rules), "event_type", "left").select("event_type", "events", F.coalesce("advice", F.lit("report")).alias("advice"))


@register("""with r as (select city, entity_no, length(canonical_name) + 40 as size, row_number() over (partition by city order by total_mentions desc, entity_no) as pos from canonical_entities where city is not null),
t as (select city, sum(size) filter (pos <= 8) as p8, sum(size) filter (pos <= 5) as p5, sum(size) filter (pos > 8 and pos <= 20) as s12, sum(size) filter (pos > 8 and pos <= 13) as s5, sum(size) filter (pos > 8 and pos <= 11) as s3, sum(size) filter (pos > 20) as b, sum(size) filter (pos > 20 and pos <= 22) as b2, count(*) filter (pos > 8 and pos <= 20) as ns, sum(12) filter (pos > 13 and pos <= 20) as moved from r group by 1),
n as (select city, (coalesce(p8, 0) + coalesce(s12, 0) + coalesce(b, 0)) / 4.0 as none, (coalesce(p8, 0) + coalesce(s5, 0) + coalesce(b, 0) + coalesce(moved, 0)) / 4.0 as light, (coalesce(p5, 0) + coalesce(s3, 0) + coalesce(b2, 0)) / 4.0 as medium, ns from t)
select city, case when none <= 120 then 'none' when ns > 5 and light <= 120 then 'light' when medium <= 120 then 'medium' else 'heavy' end as level from n""")
def compression_levels(spark: SparkSession, d: str) -> DataFrame:
    """The lightest cut of a city's context (8 first, 12 supporting, the rest behind) that fits 120 tokens of four letters."""
    c = table(spark, d, "canonical_entities").where("city is not null")
    r = c.select("city", (F.length("canonical_name") + 40).alias("size"), F.row_number().over(Window.partitionBy("city").orderBy(F.desc("total_mentions"), "entity_no")).alias("pos"))
    add = lambda lo, hi: F.coalesce(F.sum(F.when((F.col("pos") > lo) & (F.col("pos") <= hi), F.col("size"))), F.lit(0))
    rest = 2**31 - 1
    t = r.groupBy("city").agg(
        (add(0, rest) / 4.0).alias("none"), ((add(0, 13) + add(20, rest) + 12 * F.count_if(F.col("pos").between(14, 20))) / 4.0).alias("light"),
        ((add(0, 5) + add(8, 11) + add(20, 22)) / 4.0).alias("medium"), F.count_if(F.col("pos").between(9, 20)).alias("ns"),
    )
    level = F.when(F.col("none") <= 120, "none").when((F.col("ns") > 5) & (F.col("light") <= 120), "light").when(F.col("medium") <= 120, "medium").otherwise("heavy")
    return t.select("city", level.alias("level"))


@register("""select city, count(*) as entities, array_to_string(list_slice(list(canonical_name order by total_mentions desc, entity_no), 1, 3), ', ') as highlights, city || ': ' || count(*)::varchar || ' places, first of all ' || first(canonical_name order by total_mentions desc, entity_no) as summary from canonical_entities where city is not null and canonical_name is not null group by 1""")
def area_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A sentence and three highlights per area."""
    c = table(spark, d, "canonical_entities").where("city is not null and canonical_name is not null")
    w = Window.partitionBy("city").orderBy(F.desc("total_mentions"), "entity_no")
    top = c.withColumn("pos", F.row_number().over(w)).where("pos <= 3").groupBy("city").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical_name"))), lambda x: x["canonical_name"]).alias("h"))
    n = c.groupBy("city").agg(F.count("*").alias("entities"))
    text = F.concat("city", F.lit(": "), F.col("entities").cast("string"), F.lit(" places, first of all "), F.col("h")[0])
    return n.join(top, "city").select("city", "entities", F.array_join("h", ", ").alias("highlights"), text.alias("summary"))


@register("""with o as (select entity_no as slot, canonical_name as asked, 1 + entity_no % 3 as day from canonical_entities where entity_no % 2 = 0 and canonical_name is not null union all select 100000 + intake_id, entity_name, 1 + intake_id % 3 from (select distinct on (intake_id) * from entity_intake) where entity_name is not null),
m as (select canonical_name, min(entity_no) as entity_no, max(confidence_score) as c from canonical_entities group by 1) select slot, day, asked, m.entity_no, array_to_string(list_filter([case when m.entity_no is null then 'not_in_context' end, case when c < 0.6 then 'low_confidence' end], lambda x: x is not null), ',') as warnings from o left join m on m.canonical_name = o.asked""")
def outline_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of an outline with the entity that each names, and warnings for unknown and doubtful ones."""
    c = table(spark, d, "canonical_entities")
    a = c.where("entity_no % 2 = 0 and canonical_name is not null").select(F.col("entity_no").alias("slot"), F.col("canonical_name").alias("asked"), (1 + F.col("entity_no") % 3).alias("day"))
    i = table(spark, d, "entity_intake").dropDuplicates(["intake_id"]).where("entity_name is not null")
    o = a.unionByName(i.select((100000 + F.col("intake_id")).alias("slot"), F.col("entity_name").alias("asked"), (1 + F.col("intake_id") % 3).alias("day")))
    m = c.groupBy(F.col("canonical_name").alias("asked")).agg(F.min("entity_no").alias("entity_no"), F.max("confidence_score").alias("c"))
    warnings = F.array_compact(F.array(F.when(F.col("entity_no").isNull(), "not_in_context"), F.when(F.col("c") < 0.6, "low_confidence")))
    return o.join(m, "asked", "left").select("slot", "day", "asked", "entity_no", F.array_join(warnings, ",").alias("warnings"))


@register("""select profile, case when t in ('solo', 'couple', 'family', 'group') then t else 'any' end as traveler, case when b in ('budget', 'luxury') then b when b = 'mid' then 'mid-range' else 'any' end as budget, n from (select profile, split_part(profile, '_', 1) as t, split_part(profile, '_', 2) as b, n from
(select concat_ws('_', case event_id % 5 when 0 then 'solo' when 1 then 'couple' when 2 then 'family' when 3 then 'group' else 'pirate' end, case event_id % 4 when 0 then 'budget' when 1 then 'mid' when 2 then 'luxury' else '' end, event_type) as profile, count(*) as n from events group by 1))""")
def profile_parts(spark: SparkSession, d: str) -> DataFrame:
    """Profile keys 'type_tier_style' taken apart, unknown parts as 'any'."""
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "solo").when(i % 5 == 1, "couple").when(i % 5 == 2, "family").when(i % 5 == 3, "group").otherwise("pirate")
    tier = F.when(i % 4 == 0, "budget").when(i % 4 == 1, "mid").when(i % 4 == 2, "luxury").otherwise("")
    g = table(spark, d, "events").groupBy(F.concat_ws("_", kind, tier, "event_type").alias("profile")).agg(F.count("*").alias("n"))
    t, b = F.split_part("profile", F.lit("_"), F.lit(1)), F.split_part("profile", F.lit("_"), F.lit(2))
    return g.select("profile", F.when(t.isin("solo", "couple", "family", "group"), t).otherwise("any").alias("traveler"), F.when(b.isin("budget", "luxury"), b).when(b == "mid", "mid-range").otherwise("any").alias("budget"), "n")


@register("select source, count(*) as documents, min(strlen(text)) as least, max(strlen(text)) as most, round(avg(strlen(text)), 4) as mean from documents where text is not null group by 1")
def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in bytes per source."""
    n = F.octet_length("text")
    return table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("documents"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))
