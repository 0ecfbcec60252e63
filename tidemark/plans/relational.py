"""Filters, projections, joins, set operations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any, truncate
from tidemark.operators import filters
from tidemark.plans.catalog import register
from tidemark.session import table

_ONCE = "(select distinct on (mention_id) * from extracted_entities)"
_VIDEOS = "(select video_id, max(duration_seconds) as duration_seconds, max(metadata.view_count) as views, max(title) as title from videos group by 1)"


@register("""with c as (select c_nationkey as k, count(*) as customers, round(sum(c_acctbal), 4) as balance from customer group by 1), s as (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 0 group by 1)
select coalesce(c.k, s.k) as nation, coalesce(customers, 0) as customers, coalesce(balance, 0) as balance, coalesce(suppliers, 0) as suppliers from c full join s on c.k is not distinct from s.k""")
def coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k2")).agg(F.count("*").alias("suppliers"))
    return c.join(s, F.col("k").eqNullSafe(F.col("k2")), "full").select(F.coalesce("k", "k2").alias("nation"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "balance", "suppliers")])


@register("""with e as (select entity_no, city, country from canonical_entities), a as (select city, country, count(*) as n from entity_intake where city is not null group by all), b as (select country, count(*) as n from entity_intake where country is not null group by 1)
select entity_no, case when a.n is not null then 'city' when b.n is not null then 'country' else 'none' end as level, case when a.n is not null then 0.8 when b.n is not null then 0.5 else 0 end::double as weight, coalesce(a.n, b.n, 0) as related
from e left join a using (city, country) left join b on e.country = b.country""")
def entity_insight_levels(spark: SparkSession, d: str) -> DataFrame:
    intake = table(spark, d, "entity_intake")
    a = intake.where("city is not null").groupBy("city", "country").agg(F.count("*").alias("a"))
    b = intake.where("country is not null").groupBy("country").agg(F.count("*").alias("b"))
    e = table(spark, d, "canonical_entities").select("entity_no", "city", "country").join(a, ["city", "country"], "left").join(b, "country", "left")
    level = F.when(F.col("a").isNotNull(), "city").when(F.col("b").isNotNull(), "country").otherwise("none")
    weight = F.when(F.col("a").isNotNull(), 0.8).when(F.col("b").isNotNull(), 0.5).otherwise(0.0)
    return e.select("entity_no", level.alias("level"), weight.alias("weight"), F.coalesce("a", "b", F.lit(0)).alias("related"))


@register("""with r as (select lower(trim(canonical_name)) as k, entity_type as t, min(entity_no) as e from canonical_entities group by all), a as (select lower(trim(u)) as k, t, min(e) as e from (select unnest(aliases) as u, entity_type as t, entity_no as e from canonical_entities) where u is not null group by all)
select intake_id, coalesce(r.e, a.e) as entity_no, case when r.e is not null then 'name' when a.e is not null then 'alias' else 'new' end as method from entity_intake i
left join r on lower(trim(i.entity_name)) = r.k and i.entity_type = r.t left join a on lower(trim(i.entity_name)) = a.k and i.entity_type = a.t""")
def registry_match(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_entities")
    return filters.match_registry(table(spark, d, "entity_intake"), c, "intake_id", "entity_name", "entity_type")


@register("select video_id, cast(count(*) as bigint) as segments from transcripts where video_id not in (select video_id from extracted_entities where video_id is not null) group by 1")
def unindexed_videos(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "extracted_entities").where("video_id is not null").select("video_id")
    return table(spark, d, "transcripts").join(done, "video_id", "left_anti").groupBy("video_id").agg(F.count("*").alias("segments"))


@register("select count(*) as documents, count(*) filter (video_id in (select video_id from videos)) as with_video from documents where video_id is not null")
def provenance_semi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("video_id is not null")
    known = table(spark, d, "videos").select("video_id").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "video_id", "left").agg(F.count("*").alias("documents"), F.count("known").alias("with_video"))


@register(f"""select v.video_id, v.views, count(distinct e.entity_name) as entities, round(avg(e.confidence_score), 6) as mean_confidence from {_VIDEOS} v left join {_ONCE} e using (video_id) group by all""")
def entities_with_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").groupBy("video_id").agg(F.max("metadata.view_count").alias("views"))
    e = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).groupBy("video_id").agg(F.countDistinct("entity_name").alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"))
    return v.join(e, "video_id", "left").select("video_id", "views", F.coalesce("n", F.lit(0)).alias("entities"), "mean_confidence")


@register(f"""with t as (select video_id, count(distinct segment_index) as segments from transcripts group by 1), e as (select video_id, count(*) as mentions from {_ONCE} group by 1), d as (select video_id, count(*) as documents from documents where video_id is not null group by 1)
select v.video_id, coalesce(segments, 0) as segments, coalesce(mentions, 0) as mentions, coalesce(documents, 0) as documents, round(60.0 * coalesce(mentions, 0) / nullif(duration_seconds, 0), 6) as per_minute
from {_VIDEOS} v left join t using (video_id) left join e using (video_id) left join d using (video_id)""")
def videos_processing_summary(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").groupBy("video_id").agg(F.max("duration_seconds").alias("seconds"))
    t = table(spark, d, "transcripts").groupBy("video_id").agg(F.countDistinct("segment_index").alias("segments"))
    e = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).groupBy("video_id").agg(F.count("*").alias("mentions"))
    x = table(spark, d, "documents").where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("documents"))
    rows = v.join(t, "video_id", "left").join(e, "video_id", "left").join(x, "video_id", "left").fillna(0, ["segments", "mentions", "documents"])
    return rows.withColumn("per_minute", F.round(F.try_divide(60.0 * F.col("mentions"), F.nullif("seconds", F.lit(0))), 6)).drop("seconds")


@register("""with a as (select distinct doc_id from documents), b as (select distinct doc_id from review_labels)
select 'missing' as part, count(*) as n from (from a except from b) union all select 'extra', count(*) from (from b except from a) union all select 'correct', count(*) from (from a intersect from b)""")
def audit_sets(spark: SparkSession, d: str) -> DataFrame:
    return filters.audit(table(spark, d, "documents").select("doc_id"), table(spark, d, "review_labels").select("doc_id"))


@register(f"""with u as (select entity_name as name, 1 as src, count(*) as n from {_ONCE} where entity_name is not null group by all union all select entity_name, 2, count(*) from entity_intake where entity_name is not null group by all union all select canonical_name, 0, count(*) from canonical_entities group by all)
select name, src, n from u qualify row_number() over (partition by name order by src) = 1""")
def union_first_source(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, c, k: t.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("src", F.lit(k))
    parts = [
        count(table(spark, d, "canonical_entities"), "canonical_name", 0), count(table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]), "entity_name", 1),
        count(table(spark, d, "entity_intake"), "entity_name", 2),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("name").agg(F.min(F.struct("src", "n")).alias("b")).select("name", "b.src", "b.n")


@register(f"""select mention_id, round(len(list_intersect(tags, ['food', 'temple', 'solo'])) / 3.0, 6) as overlap from {_ONCE} where tags is not null""")
def interest_overlap(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("food", "temple", "solo")])
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("tags is not null").select("mention_id", F.round(F.size(F.array_intersect("tags", wanted)) / 3.0, 6).alias("overlap"))


@register("""select city, canonical_name, total_mentions from canonical_entities where city is not null qualify row_number() over (partition by city order by total_mentions desc, entity_no) <= 3""")
def city_topk(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("city").orderBy(F.desc("total_mentions"), "entity_no")
    rows = table(spark, d, "canonical_entities").where("city is not null").withColumn("at", F.row_number().over(order))
    return rows.where("at <= 3").select("city", "canonical_name", "total_mentions")


@register("""select o_orderkey, o_totalprice, cast(ceil(count(*) over () / 50.0) as bigint) as pages from orders order by o_orderdate desc, o_orderkey limit 50 offset 100""")
def page_browse(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 50).select("o_orderkey", "o_totalprice", "pages")


@register("""select p_brand, count(*) as parts, count(*) filter (p_name ilike '%green%') as matching from part group by 1""")
def ilike_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_if(F.col("p_name").ilike("%green%")).alias("matching"))


@register("""select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 200000) as favourite from customer""")
def bulk_in_check(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("favourite"))


@register("""with t as (select distinct on (video_id, segment_index) video_id, segment_index, text from transcripts where text is not null order by video_id, segment_index, text)
select video_id, count(*) as segments, md5(string_agg(text, ' ' order by segment_index)) as digest, sum(length(text))::bigint as chars from t group by 1""")
def transcript_concat(spark: SparkSession, d: str) -> DataFrame:
    return filters.ordered_text(table(spark, d, "transcripts"), "video_id", "segment_index", "text")


@register("""with t as (select entity_id, entity_name, confidence_score, mention_id from extracted_entities) select entity_id, mention_id, round(confidence_score, 6) as confidence from t qualify row_number() over (partition by entity_id order by confidence_score desc nulls last, mention_id) = 1""")
def best_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities")
    best = F.max_by(F.struct("mention_id", "confidence_score"), F.struct(F.coalesce("confidence_score", F.lit(-1.0)), -F.col("mention_id"))).alias("b")
    return rows.groupBy("entity_id").agg(best).select("entity_id", "b.mention_id", F.round("b.confidence_score", 6).alias("confidence"))


@register("""select entity_no, canonical_name, array_to_string(aliases[1:3], ', ') as top_aliases, case when length(canonical_name) > 20 then substr(canonical_name, 1, 17) || '...' else canonical_name end as short_name,
round(latitude, 3) as lat, len(coalesce(aliases, []))::int as alias_count from canonical_entities""")
def flatten_bi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").select(
        "entity_no", "canonical_name", F.array_join(F.slice("aliases", 1, 3), ", ").alias("top_aliases"), truncate(F.col("canonical_name"), 20).alias("short_name"),
        F.round("latitude", 3).alias("lat"), F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("alias_count"),
    )


@register("""select doc_id, octet_length(encode(coalesce(text, ''))) as bytes, case when octet_length(encode(coalesce(text, ''))) > 4096 then 'error' when octet_length(encode(coalesce(text, ''))) > 3584 then 'truncate' else 'ok' end as verdict from documents""")
def metadata_size_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("bytes"), F.when(n > 4096, "error").when(n > 3584, "truncate").otherwise("ok").alias("verdict"))


_NO_PLACE = "(guide|bus|airbnb|hostel)"
_GENERIC = ["the viewpoint", "some temple", "this hotel", "coffee place", "the market", "random beach", "food stall"]


@register(f"""with f as (select mention_id, lower(trim(entity_name)) as n, entity_type as t, city, confidence_score as c, experience from {_ONCE}),
g as (select *, case when coalesce(n, '') = '' then 'missing_name' when regexp_matches(n, '^(our|local|my) {_NO_PLACE}') then 'matched_pattern' when {" or ".join(f"contains(n, '{g}')" for g in _GENERIC)} then 'generic' when not contains(n, ' ') and length(n) < 6 and t in ('restaurant', 'hotel') then 'single_short_word' when city is null and c < 0.3 then 'suspicious_city' else 'keep' end as reason from f)
select mention_id, reason, case when reason = 'keep' then 'keep' when experience is not null then 'candidate' else 'filtered' end as route from g""")
def place_filter_router(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    n = F.coalesce(F.lower(F.trim("entity_name")), F.lit(""))
    rules = [
        ("missing_name", n == ""), ("matched_pattern", n.rlike(f"^(our|local|my) {_NO_PLACE}")), ("generic", contains_any(n, _GENERIC)),
        ("single_short_word", ~n.contains(" ") & (F.length(n) < 6) & F.col("entity_type").isin("restaurant", "hotel")),
        ("suspicious_city", F.col("city").isNull() & (F.col("confidence_score") < 0.3)),
    ]
    reason = filters.first_rule(rules, "keep")
    route = F.when(reason == "keep", "keep").when(F.col("experience").isNotNull(), "candidate").otherwise("filtered")
    return rows.select("mention_id", reason.alias("reason"), route.alias("route"))


@register(f"""with w as (select mention_id, list_filter([case when coalesce(trim(entity_name), '') = '' then 'missing_name' end, case when confidence_score is null or confidence_score < 0.1 or confidence_score > 1 then 'invalid_confidence' end, case when experience is null then 'no_experiences' end, case when city is null then 'no_city' end], lambda x: x is not null) as w from {_ONCE})
select mention_id, array_to_string(w, ',') as warnings, not (list_contains(w, 'missing_name') or list_contains(w, 'invalid_confidence') or list_contains(w, 'no_experiences')) as valid from w""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence_score")
    checks = {
        "missing_name": F.coalesce(F.trim("entity_name"), F.lit("")) == "", "invalid_confidence": c.isNull() | (c < 0.1) | (c > 1),
        "no_experiences": F.col("experience").isNull(), "no_city": F.col("city").isNull(),
    }
    found = filters.warnings(checks)
    bad = F.arrays_overlap(found, F.array(*[F.lit(x) for x in ("missing_name", "invalid_confidence", "no_experiences")]))
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).select("mention_id", F.array_join(found, ",").alias("warnings"), (~bad).alias("valid"))


@register(f"""select mention_id, case when lower(entity_type) in ('attraction', 'restaurant', 'hotel', 'activity', 'shopping', 'transportation') then lower(entity_type) when contains(lower(entity_name), 'hotel') or contains(lower(entity_name), 'guesthouse') then 'hotel' when contains(lower(entity_name), 'restaurant') or contains(lower(entity_name), 'kitchen') then 'restaurant' when contains(lower(entity_name), 'bazaar') or contains(lower(entity_name), 'market') then 'shopping' when contains(lower(entity_name), 'temple') or contains(lower(entity_name), 'palace') then 'attraction' else 'unknown' end as kind from {_ONCE}""")
def type_normaliser(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).select("mention_id", filters.entity_kind(F.col("entity_type"), F.col("entity_name")).alias("kind"))


@register("""select p_partkey, p_retailprice, case when p_retailprice < 1000 then 1 when p_retailprice < 1300 then 2 when p_retailprice < 1600 then 3 else 4 end as tier from part where (case when p_retailprice < 1000 then 1 when p_retailprice < 1300 then 2 when p_retailprice < 1600 then 3 else 4 end) <= 2 + 1""")
def budget_tolerance(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    tier = F.when(p < 1000, 1).when(p < 1300, 2).when(p < 1600, 3).otherwise(4)
    return table(spark, d, "part").select("p_partkey", "p_retailprice", tier.alias("tier")).where(F.col("tier") <= 2 + 1)


@register("""select entity_no, least(1.0, confidence_score + case when contains(lower(canonical_name), 'temple') then 0.3 else 0 end) as score from canonical_entities where not (contains(lower(canonical_name), 'hotel') or contains(entity_type, 'hotel') or contains(lower(canonical_name), 'transport') or contains(entity_type, 'transport'))""")
def constraint_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_entities")
    return filters.constrained(rows, F.lower("canonical_name"), F.col("entity_type"), F.col("confidence_score"), ["temple"], ["hotel", "transport"]).select("entity_no", "score")


@register("""select entity_no, u.issue as issue from (select entity_no, unnest([case when confidence_score < 0.6 then 'low_confidence' end, case when latitude is null then 'missing_geo' end, case when aliases is null then 'no_aliases' end, case when total_mentions = 1 then 'single_source' end]) as issue from canonical_entities) u where u.issue is not null""")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    checks = {
        "low_confidence": F.col("confidence_score") < 0.6, "missing_geo": F.col("latitude").isNull(), "no_aliases": F.col("aliases").isNull(),
        "single_source": F.col("total_mentions") == 1,
    }
    return table(spark, d, "canonical_entities").select("entity_no", F.explode(filters.warnings(checks)).alias("issue"))


@register("""select event_type, cast(json_extract_string(props, '$.k') as varchar) as k, count(*) as n from events group by all""")
def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@register("""select entity_no, coalesce(geocoding_source, 'none') as provider, latitude between -90 and 90 and longitude between -180 and 180 as on_earth, abs(latitude - p.lat) < 1 and abs(longitude - p.lon) < 1 as near_city
from canonical_entities c join (select city, country, min(latitude) as lat, min(longitude) as lon from places where kind = 'city' group by all) p using (city, country) where c.latitude is not null""")
def coordinate_validation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "places").where("kind = 'city'").groupBy("city", "country").agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    c = table(spark, d, "canonical_entities").where("latitude is not null").join(p, ["city", "country"])
    near = (F.abs(F.col("latitude") - F.col("lat")) < 1) & (F.abs(F.col("longitude") - F.col("lon")) < 1)
    return c.select(
        "entity_no", F.coalesce("geocoding_source", F.lit("none")).alias("provider"), (F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)).alias("on_earth"), near.alias("near_city")
    )


@register("""select source, substr(cast(created_at as varchar), 1, 7) as month, count(*) as n, count(distinct lang) as langs from documents group by rollup (source, month)""")
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return table(spark, d, "documents").select("source", month, "lang").rollup("source", "month").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))
