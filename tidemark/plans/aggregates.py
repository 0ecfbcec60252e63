"""Grouping and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import MARKED, PLAIN, count_hits, normalize_entity_text, signature, words
from tidemark.operators import grouping, scores
from tidemark.plans.catalog import register
from tidemark.session import table

#: The moment that ages are counted from, in place of the clock.
AS_OF = "2026-01-01 00:00:00"
_SIG = "concat_ws('||', coalesce(trim(lower(entity_name)), ''), coalesce(trim(lower(city)), ''), coalesce(trim(lower(entity_type)), ''))"
_ONCE = "(select distinct on (mention_id) * from extracted_entities)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])


@register(f"""select {_SIG} as signature, count(*) as mentions, min(mention_id) as first_mention from {_ONCE}
where coalesce(trim(entity_name), '') <> '' group by 1 having count(*) > 1""")
def exact_signature_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.exact_groups(mentions(spark, d), "entity_name", "city", "entity_type", "mention_id")


@register("""select group_id, canonical_name, n as name_count, k - 1 as alternatives from (
  select *, count(*) over (partition by group_id) as k, row_number() over (partition by group_id order by n desc, length(canonical_name) desc, canonical_name) as pos
  from (select group_id, canonical_name, count(*) as n from (select distinct on (record_id) * from canonical_snapshots) where canonical_name is not null group by all)) where pos = 1""")
def canonical_name_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"])
    return grouping.mode_name(rows, "group_id", "canonical_name")


@register("""with n as (select group_id, canonical_name, count(*) as n from (select distinct on (record_id) * from canonical_snapshots) where canonical_name is not null group by all),
best as (select group_id, canonical_name from n qualify row_number() over (partition by group_id order by n desc, length(canonical_name) desc, canonical_name) = 1)
select b.group_id, b.canonical_name, coalesce(string_agg(n.canonical_name, '|' order by n.canonical_name) filter (n.canonical_name <> b.canonical_name), '') as aliases
from best b join n using (group_id) group by 1, 2""")
def alias_set(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_snapshots").dropDuplicates(["record_id"])
    return grouping.alias_sets(rows, "group_id", "canonical_name")


@register(f"""with t as (select entity_name, unnest(tags) as tag, mention_id from {_ONCE} where entity_name is not null),
c as (select entity_name, tag, count(*) as n, min(mention_id) as f from t where tag is not null group by all)
select entity_name, string_agg(tag, ',' order by n desc, f, tag) as keywords from c group by 1""")
def attribute_merge(spark: SparkSession, d: str) -> DataFrame:
    return grouping.frequent_values(mentions(spark, d).where("entity_name is not null"), "entity_name", "tags", "mention_id", "keywords")


@register(f"""select {_SIG} as signature, arg_min(entity_type, mention_id) as entity_type, arg_min(coalesce(city, ''), mention_id) as city, count(*) as total_mentions,
count(distinct video_id) as videos from {_ONCE} where coalesce(trim(entity_name), '') <> '' group by 1""")
def group_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).where(F.coalesce(F.trim("entity_name"), F.lit("")) != "")
    return rows.groupBy(signature(F.col("entity_name"), F.col("city"), F.col("entity_type")).alias("signature")).agg(
        F.min_by("entity_type", "mention_id").alias("entity_type"), F.min_by(F.coalesce("city", F.lit("")), "mention_id").alias("city"),
        F.count("*").alias("total_mentions"), F.countDistinct("video_id").alias("videos"),
    )


@register(f"""with g as (select {_SIG} as s, count(*) as n from {_ONCE} where coalesce(trim(entity_name), '') <> '' group by 1)
select count(*) as entities, cast(sum(n) as bigint) as mentions, round(avg(n), 6) as avg_mentions, round(1 - count(*) / sum(n), 6) as duplicate_rate from g""")
def batch_canonical_stats(spark: SparkSession, d: str) -> DataFrame:
    g = group_canonicalise(spark, d)
    return g.agg(
        F.count("*").alias("entities"), F.sum("total_mentions").alias("mentions"), F.round(F.avg("total_mentions"), 6).alias("avg_mentions"),
        F.round(1 - F.count("*") / F.sum("total_mentions"), 6).alias("duplicate_rate"),
    )


@register(f"""select video_id, trim(lower(entity_name)) as name, max(confidence_score) as confidence, min(timestamp_start) as first_at,
case when count(distinct sentiment) <= 1 then coalesce(min(sentiment), 'neutral') else 'mixed' end as sentiment,
coalesce(string_agg(distinct cost_mentioned, ', ' order by cost_mentioned), '') as costs
from {_ONCE} where entity_name is not null group by 1, 2""")
def video_group_merge(spark: SparkSession, d: str) -> DataFrame:
    return grouping.merge_in_video(mentions(spark, d).where("entity_name is not null"))


# Words of approval and disapproval.
GOOD, BAD = ["great", "loved", "lovely", "perfect", "worth", "glad"], ["overpriced", "salty", "late", "missed", "broke", "nobody"]


@register(f"""with s as (select source, {" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in GOOD)} as g, {" + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in BAD)} as b from documents where text is not null)
select source, case when g > 0 and b > 0 then 'mixed' when g > 0 then 'positive' when b > 0 then 'negative' else 'neutral' end as sentiment, count(*) as n from s group by all""")
def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("text")
    g, b = count_hits(text, GOOD), count_hits(text, BAD)
    label = F.when((g > 0) & (b > 0), "mixed").when(g > 0, "positive").when(b > 0, "negative").otherwise("neutral")
    return table(spark, d, "documents").where("text is not null").groupBy("source", label.alias("sentiment")).agg(F.count("*").alias("n"))


@register("""with c as (select source, unnest(regexp_extract_all(text, '([0-9]+) coins', 1)) as v from documents)
select source, count(*) as n, min(cast(v as double)) as least, max(cast(v as double)) as most, round(avg(cast(v as double)), 6) as mean from c group by 1""")
def cost_extract(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+) coins"), F.lit(1))).alias("v"))
    v = F.col("v").try_cast("double")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))


@register(f"""with n as (select entity_name, coalesce(sentiment, 'neutral') as s, count(*) as n from {_ONCE} where entity_name is not null group by all),
p as (select entity_name, coalesce(entity_type, 'unknown') as t, count(*) as n from {_ONCE} where entity_name is not null group by all),
a as (select entity_name, max(n) / sum(n) as share, arg_max(s, (n, s)) as top from n group by 1), b as (select entity_name, max(n) / sum(n) as share from p group by 1)
select entity_name, a.top as dominant_sentiment, round((a.share + b.share) / 2, 6) as consensus from a join b using (entity_name)""")
def consensus_score(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).where("entity_name is not null").select("entity_name", F.coalesce("sentiment", F.lit("neutral")).alias("s"), F.coalesce("entity_type", F.lit("unknown")).alias("t"))
    return scores.consensus(rows, "entity_name", "s", "t")


@register("""with w as (select source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from documents where source is not null),
c as (select source, word, count(*) as n from w where word not in ('the', 'and', 'que', 'for', 'was') group by all)
select source, word, n from c qualify row_number() over (partition by source order by n desc, word) <= 5""")
def theme_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source is not null").select("source", F.explode(words(F.col("text"))).alias("word"))
    n = rows.where(~F.col("word").isin("the", "and", "que", "for", "was")).groupBy("source", "word").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return n.withColumn("at", at).where("at <= 5").drop("at")


@register(f"""select entity_name, count(*) as mentions, count(distinct video_id) as videos, round(0.6 * least(1, count(*) / 20) + 0.4 * least(1, count(distinct video_id) / 10), 3) as popularity
from {_ONCE} where entity_name is not null group by 1""")
def popularity(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).where("entity_name is not null").groupBy("entity_name").agg(F.count("*").alias("mentions"), F.countDistinct("video_id").alias("videos"))
    return rows.withColumn("popularity", scores.popularity(F.col("mentions"), F.col("videos")))


@register(f"""with a as (select entity_name, date_diff('day', cast(max(extracted_at) as date), date '2026-01-01') as days from {_ONCE} where entity_name is not null group by 1)
select entity_name, cast(days as int) as days, case when days is null then 0.5 when days <= 30 then 1.0 when days <= 90 then 0.8 when days <= 180 then 0.6 when days <= 365 then 0.4 else 0.2 end::double as freshness from a""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).where("entity_name is not null").groupBy("entity_name").agg(F.max("extracted_at").alias("last"))
    days = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("last"))
    return rows.select("entity_name", days.alias("days"), scores.freshness(days).alias("freshness"))


@register(f"""with a as (select entity_name, count(rating) as n, avg(rating) as r, avg(case sentiment when 'positive' then 5.0 when 'negative' then 1.0 else 3.0 end) as s, avg(confidence_score) as c
from {_ONCE} where entity_name is not null group by 1),
w as (select *, case when n > 0 then least(0.5, 0.4 + 0.05 * (n - 1)) else 0 end as wr, 0.3 * coalesce(c, 0) as ws from a)
select entity_name, n as ratings, round((coalesce(r, 0) * wr + s * ws) / nullif(wr + ws, 0), 6) as rating from w""")
def weighted_rating(spark: SparkSession, d: str) -> DataFrame:
    return scores.weighted_rating(mentions(spark, d).where("entity_name is not null"), "entity_name")


@register("""select count(*) as entities, count(latitude) as located, count(*) filter (len(aliases) > 0) as with_aliases, round(100.0 * count(latitude) / count(*), 4) as located_pct,
round(avg(confidence_score) filter (confidence_score > 0), 6) as mean_confidence, count(*) filter (geocoding_source = 'google_maps') as by_google from canonical_entities""")
def enrichment_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").agg(
        F.count("*").alias("entities"), F.count("latitude").alias("located"), F.count_if(F.size("aliases") > 0).alias("with_aliases"),
        F.round(100.0 * F.count("latitude") / F.count("*"), 4).alias("located_pct"),
        F.round(F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score"))), 6).alias("mean_confidence"),
        F.count_if(F.col("geocoding_source") == "google_maps").alias("by_google"),
    )


@register("""select city, country, count(*) as entities, count(*) filter (entity_type = 'hotel') as hotels, count(*) filter (entity_type = 'restaurant') as restaurants,
count(*) filter (entity_type = 'attraction') as attractions, round(avg(confidence_score), 6) as mean_confidence, round(avg(latitude), 6) as latitude, round(avg(longitude), 6) as longitude,
least(7, greatest(1, cast(ceil(count(*) / 4.0) as int))) as days from canonical_entities where city is not null group by all having count(*) >= 5""")
def city_rollup(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"hotels": "hotel", "restaurants": "restaurant", "attractions": "attraction"}
    return table(spark, d, "canonical_entities").where("city is not null").groupBy("city", "country").agg(
        F.count("*").alias("entities"), *[F.count_if(F.col("entity_type") == v).alias(k) for k, v in kinds.items()],
        F.round(F.avg("confidence_score"), 6).alias("mean_confidence"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"),
        F.least(F.lit(7), F.greatest(F.lit(1), F.ceil(F.count("*") / 4.0).cast("int"))).alias("days"),
    ).where("entities >= 5")


@register("""with c as (select source, lang, arg_max(text, (length(text), -doc_id)) as content, count(*) as n, round(avg(n_chars), 6) as mean_chars, max(created_at) as last
from documents where source is not null and lang is not null and text is not null group by all)
select source, lang, content, n as mentions, mean_chars, round(0.25 * least(1, length(content) / 200.0) + 0.35 * 0.5 + 0.25 * least(1, n / 10.0) + 0.15, 6) as quality from c""")
def insight_consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source is not null and lang is not null and text is not null").groupBy("source", "lang").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("doc_id"))).alias("content"), F.count("*").alias("mentions"), F.round(F.avg("n_chars"), 6).alias("mean_chars")
    )
    return rows.withColumn("quality", F.round(scores.insight_quality(F.length("content"), F.lit(0.5), F.col("mentions"), F.lit(1.0)), 6))


@register(f"""select entity_type, country, count(*) as n, count(distinct city) as cities from {_ONCE} group by grouping sets ((entity_type), (country), (entity_type, country), ())""")
def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d)
    sets = [[F.col("entity_type"), F.col("country")], [F.col("entity_type")], [F.col("country")], []]
    return rows.groupingSets(sets, F.col("entity_type"), F.col("country")).agg(F.count("*").alias("n"), F.countDistinct("city").alias("cities"))


@register("""select event_type, count(*) filter (user_id % 4 = 0) as pending, count(*) filter (user_id % 4 = 1) as processing, count(*) filter (user_id % 4 = 2) as complete,
count(*) filter (user_id % 4 = 3) as failed, round(avg(value), 6) as mean_value from events group by 1""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    names = ["pending", "processing", "complete", "failed"]
    rows = table(spark, d, "events")
    # conditional counts are one partial aggregation; a pivot would need two
    return rows.groupBy("event_type").agg(*[F.count_if(F.col("user_id") % 4 == k).alias(n) for k, n in enumerate(names)], F.round(F.avg("value"), 6).alias("mean_value"))


@register("select coalesce(lang, 'unknown') as lang, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from documents group by 1")
def language_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@register("""select count(*) as rows, count(*) filter (l_returnflag = 'R') as returned, round(100.0 * count(*) filter (l_returnflag = 'R') / count(*), 4) as returned_pct,
count(distinct l_suppkey) as suppliers, round(avg(l_quantity), 6) as mean_quantity from lineitem""")
def kpi_dashboard(spark: SparkSession, d: str) -> DataFrame:
    back = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("rows"), back.alias("returned"), F.round(100.0 * back / F.count("*"), 4).alias("returned_pct"), F.countDistinct("l_suppkey").alias("suppliers"),
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
    )


@register("""select source, count(*) as documents, cast(sum(ceil(len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) * 1.3)) as bigint) as tokens from documents group by 1""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = F.ceil(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0))) * 1.3)
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"))


@register("""with r(l_returnflag, rate) as (values ('A', 0.15), ('N', 0.6), ('R', 2.5)), c as (select l_returnflag, count(*) as calls, sum(l_quantity) * any_value(rate) / 1000 as cost from lineitem join r using (l_returnflag) group by 1)
select l_returnflag as provider, calls, round(cost, 2) as cost, round(100 * cost / sum(cost) over (), 4) as pct, case when cost > 0.8 * sum(cost) over () then 'warn' else 'ok' end as budget from c""")
def cost_tracker(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("A", 0.15), ("N", 0.6), ("R", 2.5)], "l_returnflag string, rate double")
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("calls"), F.sum("l_quantity").alias("units")).join(F.broadcast(rates), "l_returnflag")
    cost = F.col("units") * F.col("rate") / 1000
    total = F.sum("raw").over(Window.partitionBy(F.lit(1)))
    return c.withColumn("raw", cost).select(
        F.col("l_returnflag").alias("provider"), "calls", F.round("raw", 2).alias("cost"), F.round(100 * F.col("raw") / total, 4).alias("pct"),
        F.when(F.col("raw") > 0.8 * total, "warn").otherwise("ok").alias("budget"),
    )


@register("""with n as (select city, entity_type, count(*) as n from canonical_entities where city is not null group by all), s as (select city, sum(n) as t, count(*) as k from n group by 1)
select city, round(case when k = 1 then 0 else sum(-n / t * ln(n / t)) / ln(k) end, 6) as type_entropy, k as types from n join s using (city) group by city, k, t""")
def diversity_score(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "canonical_entities").where("city is not null").groupBy("city", "entity_type").agg(F.count("*").alias("n"))
    return scores.entropy(n, "city", "n")


@register("""with t as (select source, lang, count(*) as n from documents where source is not null group by all) select source, lang as main_lang, n from t qualify row_number() over (partition by source order by n desc, lang nulls last) = 1""")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("source is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.col("lang").asc_nulls_last()))
    return n.withColumn("at", at).where("at = 1").select("source", F.col("lang").alias("main_lang"), "n")


@register(f"""select video_id, substr(md5(substr(coalesce(experience, ''), 1, 500)), 1, 12) as key, min(mention_id) as kept, count(*) as copies from {_ONCE} group by all""")
def experience_dedupe(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring(F.md5(F.substring(F.coalesce("experience", F.lit("")), 1, 500)), 1, 12)
    return mentions(spark, d).groupBy("video_id", key.alias("key")).agg(F.min("mention_id").alias("kept"), F.count("*").alias("copies"))


@register(f"""select translate(lower(entity_name), '{MARKED}', '{PLAIN}') as folded, count(*) as n from {_ONCE} where entity_name is not null group by 1""")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import fold_marks

    return mentions(spark, d).where("entity_name is not null").groupBy(fold_marks(F.col("entity_name")).alias("folded")).agg(F.count("*").alias("n"))


@register(f"""select trim(regexp_replace(regexp_replace(translate(lower(entity_name), '{MARKED}', '{PLAIN}'), '[^a-z0-9\\s\\-'']', '', 'g'), '\\s+', ' ', 'g')) as name, count(*) as n from {_ONCE} where entity_name is not null group by 1""")
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).where("entity_name is not null").groupBy(normalize_entity_text(F.col("entity_name")).alias("name")).agg(F.count("*").alias("n"))
