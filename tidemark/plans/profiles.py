"""Profiles, attributes, lookups, itinerary checks and the rest of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any
from tidemark.operators import filters, profiles, sequential
from tidemark.plans.catalog import register
from tidemark.session import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ONCE = "(select distinct on (mention_id) * from extracted_entities)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])


_KIND = "case c_custkey % 5 when 0 then 'solo' when 1 then 'couple' when 2 then 'family' when 3 then 'group' end"
_TIER = "case when c_acctbal < 0 then 'budget' when c_acctbal < 5000 then 'mid-range' else 'luxury' end"
_STYLE = "case c_custkey % 7 when 0 then ['party', 'social'] when 1 then ['adventure'] when 2 then ['cultural', 'history'] when 3 then ['romantic'] when 4 then ['remote work'] else [] end"
_VALUES = ", ".join(
    f"({i}, '{n}', {repr(k) if k else 'null'}, {repr(t) if t else 'null'}, {w if w else '[]::varchar[]'})" for i, (n, k, t, w) in enumerate(profiles.BUCKETS)
)


@register(f"""with b(o, name, k, t, w) as (values {_VALUES}), c as (select c_custkey, {_KIND} as kind, {_TIER} as tier, {_STYLE} as styles from customer),
s as (select c_custkey, kind, tier, o, name, len(list_filter(w, lambda x: len(list_filter(styles, lambda y: contains(y, x))) > 0)) as hits, len(w) as need, k, t from c, b),
p as (select *, case when (k is null or coalesce(kind = k, false)) and (t is null or tier = t) and (need = 0 or hits > 0) then (case when k is null then 0 else 10 end) + (case when t is null then 0 else 10 end) + 5 * hits else 0 end as points from s)
select c_custkey, case when max(points) > 0 then arg_max(name, (points, -o)) else 'other_' || coalesce(any_value(kind), 'unknown') || '_' || any_value(tier) end as bucket from p group by 1""")
def profile_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _buckets(spark, d).select("c_custkey", "bucket")


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    kind = F.when(k % 5 == 0, "solo").when(k % 5 == 1, "couple").when(k % 5 == 2, "family").when(k % 5 == 3, "group")
    tier = F.when(bal < 0, "budget").when(bal < 5000, "mid-range").otherwise("luxury")
    style = {0: ["party", "social"], 1: ["adventure"], 2: ["cultural", "history"], 3: ["romantic"], 4: ["remote work"]}
    styles = F.coalesce(*[F.when(k % 7 == i, F.array(*[F.lit(s) for s in w])) for i, w in style.items()], F.array().cast("array<string>"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", kind.alias("kind"), tier.alias("tier"), styles.alias("styles"))
    return rows.withColumn("bucket", profiles.bucket(F.col("kind"), F.col("tier"), F.col("styles")))


_METRICS = f"(select entity_name, coalesce(entity_type, 'unknown') as profile, count(*) as n, round(avg(case sentiment when 'positive' then 5.0 when 'negative' then 1.0 else 3.0 end), 6) as rating, round(least(count(*) / 10, 1), 6) as confidence from {_ONCE} where entity_name is not null group by all)"


@register(f"from {_METRICS}")
def profile_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("entity_name is not null").withColumn("profile", F.coalesce("entity_type", F.lit("unknown")))
    return profiles.metrics(rows, "entity_name", "profile", "sentiment")


@register(f"""select entity_name, coalesce(string_agg(profile, ',' order by rating desc, profile) filter (n >= 2 and rating >= 4), '') as best_for, coalesce(string_agg(profile, ',' order by rating, profile) filter (n >= 2 and rating < 3), '') as not_for, round(sum(rating * n) / sum(n), 6) as overall from {_METRICS} group by 1""")
def best_for(spark: SparkSession, d: str) -> DataFrame:
    return profiles.recommendations(profile_metrics(spark, d), "entity_name", "profile")


@register("""with c as (select city, cast(month(created_at) as varchar) as m, count(*) as n from (select e.city, i.created_at from canonical_entities e join canonical_entities i using (city)) group by all)
select city, string_agg(m, ',' order by n desc, m) as top from (select * from c qualify row_number() over (partition by city order by n desc, m) <= 3) where city is not null group by 1""")
def season_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_entities").where("city is not null")
    per = e.groupBy("city").agg(F.count("*").alias("k"))
    n = e.groupBy("city", F.month("created_at").cast("string").alias("m")).agg(F.count("*").alias("j")).join(per, "city").withColumn("n", F.col("j") * F.col("k"))
    at = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("n"), "m"))
    order = F.array_sort(F.collect_list(F.struct("at", "m")))
    return n.withColumn("at", at).where("at <= 3").groupBy("city").agg(F.array_join(F.transform(order, lambda x: x["m"]), ",").alias("top"))


@register(f"""with t as (select city, unnest(tags) as tag from {_ONCE} where city is not null), c as (select city, tag, count(*) as n from t where tag is not null group by all)
select city, string_agg(tag, ',' order by n desc, tag) as top from (select * from c qualify row_number() over (partition by city order by n desc, tag) <= 3) group by 1""")
def top_common(spark: SparkSession, d: str) -> DataFrame:
    return profiles.top_values(_mentions(spark, d).where("city is not null").select("city", F.explode("tags").alias("tag")), "city", "tag", 3)


# lower case of the 26 letters only: the engines differ on rarer ones
_CONTENT = f"md5(regexp_replace(regexp_replace(translate(text, '{UPPER}', '{UPPER.lower()}'), '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g'))"


@register(f"""with d as (select doc_id, {_CONTENT} as h from documents where text is not null), h as (select h, min(doc_id) as first from d group by 1) select doc_id, first as canonical_id, doc_id <> first as repeated from d join h using (h)""")
def insight_hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), "[ \\t\\r\\n]+", " "), "^ | $", "")).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("canonical_id"))
    return rows.join(first, "h").select("doc_id", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("repeated"))


@register("""select e.entity_no, coalesce(e.latitude, p.lat) as latitude, case when e.latitude is not null then 'own' when p.lat is not null then 'city' else 'none' end as origin from canonical_entities e left join (select city, country, min(latitude) as lat from places where kind = 'city' group by all) p using (city, country)""")
def geocode_apply(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "places").where("kind = 'city'").groupBy("city", "country").agg(F.min("latitude").alias("lat"))
    e = table(spark, d, "canonical_entities").join(p, ["city", "country"], "left")
    origin = F.when(F.col("latitude").isNotNull(), "own").when(F.col("lat").isNotNull(), "city").otherwise("none")
    return e.select("entity_no", F.coalesce("latitude", "lat").alias("latitude"), origin.alias("origin"))


@register("""select v.video_id, count(distinct e.mention_id) as mentions, count(distinct d.doc_id) as documents from (select distinct video_id from videos) v left join extracted_entities e using (video_id) left join documents d using (video_id) group by 1""")
def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id").distinct()
    e = table(spark, d, "extracted_entities").groupBy("video_id").agg(F.countDistinct("mention_id").alias("mentions"))
    x = table(spark, d, "documents").groupBy("video_id").agg(F.countDistinct("doc_id").alias("documents"))
    return v.join(e, "video_id", "left").join(x, "video_id", "left").fillna(0, ["mentions", "documents"])


@register("""with s as (select user_id, bool_or(event_type = 'signup') as crawled, bool_or(event_type = 'purchase') as extracted, bool_or(event_type = 'error') as failed from events group by 1) select user_id from s where crawled and not extracted or failed and extracted""")
def ready_work(spark: SparkSession, d: str) -> DataFrame:
    has = lambda t: F.bool_or(F.col("event_type") == t)
    s = table(spark, d, "events").groupBy("user_id").agg(has("signup").alias("a"), has("purchase").alias("b"), has("error").alias("c"))
    return s.where("a and not b or c and b").select("user_id")


@register(f"select count(*) filter (list_contains(tags, 'food')) as food, count(*) filter (list_contains(tags, 'temple') and rating >= 4) as temples, count(*) as total from {_ONCE}")
def array_contains_scan(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).agg(F.count_if(F.array_contains("tags", "food")).alias("food"), F.count_if(F.array_contains("tags", "temple") & (F.col("rating") >= 4)).alias("temples"), F.count("*").alias("total"))


@register("""select user_id, stage, n from (select user_id, count(*) filter (event_type = 'error') as crawl, count(*) filter (event_type = 'error' and value > 50) as index from events group by 1) unpivot (n for stage in (crawl, index)) where n > 2""")
def failed_stages(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    s = table(spark, d, "events").groupBy("user_id").agg(F.count_if(bad).alias("crawl"), F.count_if(bad & (F.col("value") > 50)).alias("index"))
    return s.unpivot(["user_id"], ["crawl", "index"], "stage", "n").where("n > 2")


@register("""select distinct on (video_id) video_id, title, printf('%d:%02d', duration_seconds // 60, duration_seconds % 60) as length, coalesce(len(speakers), 0)::int as voices, metadata.view_count as views from videos where duration_seconds is not null order by video_id, fetched_at desc, views desc""")
def video_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "videos").where("duration_seconds is not null")
    s = F.col("duration_seconds")
    rows = filters.latest(rows, "video_id", [F.desc("fetched_at"), F.col("metadata.view_count").desc()])
    length = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return rows.select("video_id", "title", length.alias("length"), F.size(F.coalesce("speakers", F.array().cast("array<string>"))).alias("voices"), F.col("metadata.view_count").alias("views"))


_FAR = ["city", "area", "country", "region", "beach"]


@register(f"""select mention_id, case when confidence_score is null or confidence_score < 0.1 or confidence_score > 1 then 'confidence' when coalesce(trim(location), '') in ('here', 'n/a', 'various', 'tbd', 'none', '-') then 'generic_location' when regexp_matches(lower(trim(entity_name)), '^((the|a|an|our|local|some) )?(bus|train|taxi|ferry|boat)(e?s)?$') then 'generic_transport' when lower(trim(entity_name)) in ({", ".join(f"'{w}'" for w in _FAR)}) then 'broad' else 'pass' end as gate from {_ONCE}""")
def extraction_gate(spark: SparkSession, d: str) -> DataFrame:
    c, n = F.col("confidence_score"), F.lower(F.trim("entity_name"))
    rules = [
        ("confidence", c.isNull() | (c < 0.1) | (c > 1)), ("generic_location", F.coalesce(F.trim("location"), F.lit("")).isin("here", "n/a", "various", "tbd", "none", "-")),
        ("generic_transport", n.rlike(r"^((the|a|an|our|local|some) )?(bus|train|taxi|ferry|boat)(e?s)?$")), ("broad", n.isin(_FAR)),
    ]
    return _mentions(spark, d).select("mention_id", filters.first_rule(rules, "pass").alias("gate"))


@register(f"""select mention_id, length(trim(entity_name)) >= 4 and not regexp_matches(lower(entity_name), '^(the|some|a|our|local) |stall|airbnb') as geocodable from {_ONCE} where entity_name is not null""")
def geocodable(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.length(F.trim("entity_name")) >= 4) & ~F.lower("entity_name").rlike("^(the|some|a|our|local) |stall|airbnb")
    return _mentions(spark, d).where("entity_name is not null").select("mention_id", ok.alias("geocodable"))


@register(f"""select mention_id, round(confidence_score * coalesce(rating, 3) / 5, 6) as score from {_ONCE} where confidence_score > 0.4 or rating > 3.5 order by round(confidence_score * coalesce(rating, 3) / 5, 6) desc nulls last, mention_id limit 20""")
def prefilter(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(F.col("confidence_score") * F.coalesce("rating", F.lit(3.0)) / 5, 6)
    return _mentions(spark, d).where("confidence_score > 0.4 or rating > 3.5").select("mention_id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "mention_id").limit(20)


@register("select entity_no, canonical_name, total_mentions from canonical_entities order by total_mentions desc, entity_no limit 15")
def nlargest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").orderBy(F.desc("total_mentions"), "entity_no").limit(15).select("entity_no", "canonical_name", "total_mentions")


@register(f"""select video_id, lower(trim(entity_name)) as name, min(mention_id) as kept from {_ONCE} where entity_name is not null group by all""")
def signature_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).where("entity_name is not null").groupBy("video_id", F.lower(F.trim("entity_name")).alias("name")).agg(F.min("mention_id").alias("kept"))


@register("""with w as (select unnest(regexp_extract_all(lower(coalesce(canonical_name, '')), '[a-z]{4,}')) as word, entity_no from canonical_entities) select entity_no, count(*) as keywords, min(word) as first_word from w where word not in ('hotel', 'beach') group by 1""")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_entities").select("entity_no", F.explode(F.regexp_extract_all(F.lower(F.coalesce("canonical_name", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return rows.where(~F.col("word").isin("hotel", "beach")).groupBy("entity_no").agg(F.count("*").alias("keywords"), F.min("word").alias("first_word"))


@register("""select entity_no, case when contains(lower(canonical_name), 'museum') then 0.9 when contains(lower(canonical_name), 'palace') then 0.85 else greatest(0.3, least(0.85, 0.3 + 0.01 * total_mentions + 0.2 * confidence_score)) end::double as fame from canonical_entities""")
def fame_score(spark: SparkSession, d: str) -> DataFrame:
    n = F.lower("canonical_name")
    guess = F.greatest(F.lit(0.3), F.least(F.lit(0.85), 0.3 + 0.01 * F.col("total_mentions") + 0.2 * F.col("confidence_score")))
    return table(spark, d, "canonical_entities").select("entity_no", F.when(n.contains("museum"), 0.9).when(n.contains("palace"), 0.85).otherwise(guess).alias("fame"))


@register("""with q as (select doc_id, lower(text) as t from documents where text is not null) select doc_id, case when contains(t, 'kids') or contains(t, 'family') then 'family' when contains(t, 'couple') then 'couple' when contains(t, 'solo') then 'solo' else 'unknown' end as traveller, case when contains(t, 'luxury') then 'luxury' when contains(t, 'budget') then 'budget' else 'mid-range' end as tier,
coalesce(try_cast(nullif(regexp_extract(t, '([0-9]+) days?', 1), '') as int), case when contains(t, 'week') then 7 else 3 end) as days from q""")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    who = filters.first_rule([("family", contains_any(t, ["kids", "family"])), ("couple", t.contains("couple")), ("solo", t.contains("solo"))], "unknown")
    tier = filters.first_rule([("luxury", t.contains("luxury")), ("budget", t.contains("budget"))], "mid-range")
    days = F.coalesce(F.nullif(F.regexp_extract(t, "([0-9]+) days?", 1), F.lit("")).try_cast("int"), F.when(t.contains("week"), 7).otherwise(3))
    return table(spark, d, "documents").where("text is not null").select("doc_id", who.alias("traveller"), tier.alias("tier"), days.alias("days"))


@register("""with s as (select l_orderkey as day, count(*) as slots, round(sum(l_extendedprice), 4) as budget, round(avg(l_discount), 6) as confidence, max(l_quantity) as longest from lineitem group by 1)
select day, slots, budget, case when confidence < 0.03 then 'low' when confidence < 0.06 then 'medium' else 'high' end as band, slots > 4 as crowded, longest > 48 as too_long from s""")
def itinerary_rules(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("day")).agg(
        F.count("*").alias("slots"), F.round(F.sum("l_extendedprice"), 4).alias("budget"), F.round(F.avg("l_discount"), 6).alias("c"), F.max("l_quantity").alias("m")
    )
    band = F.when(F.col("c") < 0.03, "low").when(F.col("c") < 0.06, "medium").otherwise("high")
    return s.select("day", "slots", "budget", band.alias("band"), (F.col("slots") > 4).alias("crowded"), (F.col("m") > 48).alias("too_long"))


@register("""select count(*) as orphans, count(distinct e.video_id) as videos from extracted_entities e where not exists (select 1 from videos v where v.video_id = e.video_id)""")
def provenance_orphans(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "videos").select("video_id")
    return table(spark, d, "extracted_entities").join(known, "video_id", "left_anti").agg(F.count("*").alias("orphans"), F.countDistinct("video_id").alias("videos"))


@register("""select coalesce(geocoding_source, 'none') as provider, count(*) as n, round(100.0 * count(*) filter (latitude is null or abs(latitude) > 60) / count(*), 4) as out_pct, count(*) filter (latitude is null or abs(latitude) > 60) < 0.05 * count(*) as passed from canonical_entities group by 1""")
def geo_bounds(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count_if(F.col("latitude").isNull() | (F.abs("latitude") > 60))
    return table(spark, d, "canonical_entities").groupBy(F.coalesce("geocoding_source", F.lit("none")).alias("provider")).agg(
        F.count("*").alias("n"), F.round(100.0 * bad / F.count("*"), 4).alias("out_pct"), (bad < 0.05 * F.count("*")).alias("passed")
    )


@register("""select source, case when count(*) >= 100 then 'high' when count(*) >= 20 then 'medium' else 'low' end as band, count(distinct video_id) as sources, min(n_chars) as least, max(n_chars) as most from documents where source is not null group by 1""")
def data_quality_band(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(
        F.when(n >= 100, "high").when(n >= 20, "medium").otherwise("low").alias("band"), F.countDistinct("video_id").alias("sources"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")
    )


@register()
def geo_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of two kilometres per city, in order of id; order-dependent, tested against brute force."""
    rows = table(spark, d, "canonical_entities").where("latitude is not null and city is not null")
    return sequential.greedy_clusters(rows, "city", "entity_no", "latitude", "longitude", 2.0)


@register()
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose name or alias holds the query, by best partial ratio of 60 or more."""
    return sequential.search_names(table(spark, d, "canonical_entities"), "entity_no", "canonical_name", "aliases", "night market", 60.0)


@register()
def corrected_words(spark: SparkSession, d: str) -> DataFrame:
    """Typed words and the known place they are closest to (sequence ratio 0.85 or more)."""
    known = table(spark, d, "places").where("kind = 'city'").select(F.lower("city").alias("known")).distinct()
    typed = table(spark, d, "extracted_entities").where("city is not null").select(F.lower(F.trim("city")).alias("word")).distinct()
    return sequential.correct_words(typed, known, "word", "known", 0.85)
