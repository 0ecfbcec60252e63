"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.functions.text import MARKED, PLAIN, city_key, normalize_location, normalize_name, url_hash, video_id
from tidemark.plans.catalog import register
from tidemark.session import table


@register("""select distinct source_url, regexp_extract(source_url, '(?:v=|youtu\\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})', 1) as id, substr(md5(regexp_replace(regexp_replace(lower(source_url), '[?#].*$', ''), '/+$', '')), 1, 8) as hash from videos where source_url is not null""")
def content_id(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return table(spark, d, "videos").where(u.isNotNull()).select(u, video_id(u).alias("id"), url_hash(u).alias("hash")).distinct()


@register("""with l as (select distinct location from extracted_entities where location is not null), p as (select location, list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: x <> '') as p from l)
select location, case when len(p) = 0 then '' when len(p) >= 2 then p[1] else p[1] end as city, case when len(p) >= 2 then p[len(p)] else '' end as country from p""")
def parse_location(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").where("location is not null").select("location").distinct()
    city, country = parsing.city_country(F.col("location"))
    return rows.select("location", city.alias("city"), country.alias("country"))


@register("""select canonical_name, substr(regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g'), 1, 15) as key, count(*) as n from canonical_entities group by all""")
def city_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").groupBy("canonical_name", city_key(F.col("canonical_name")).alias("key")).agg(F.count("*").alias("n"))


@register("""with n as (select distinct entity_name as e from entity_intake where entity_name is not null) select e as entity_name, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', '') as name from n""")
def registry_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_intake").where("entity_name is not null").select("entity_name").distinct()
    return rows.select("entity_name", normalize_name(F.col("entity_name")).alias("name"))


@register("""select p_partkey, case when p_size % 3 = 0 then p_size || ' minutes' when p_size % 3 = 1 then p_size || ' hours' else 'PT' || p_size || 'M' end as text,
case when p_size % 3 = 0 then p_size when p_size % 3 = 1 then p_size * 60 else p_size end::int as minutes from part""")
def duration_minutes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit(" minutes"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" hours"))).otherwise(F.concat(F.lit("PT"), n, F.lit("M")))
    return table(spark, d, "part").select("p_partkey", text.alias("text")).withColumn("minutes", parsing.minutes(F.col("text")))


@register("""select distinct cost_mentioned, coalesce(try_cast(regexp_extract(cost_mentioned, '([0-9]+)', 1) as double), 0) as low, coalesce(try_cast(regexp_extract(cost_mentioned, '[0-9]+ *- *([0-9]+)', 1) as double), try_cast(regexp_extract(cost_mentioned, '([0-9]+)', 1) as double), 0) as high from extracted_entities where cost_mentioned is not null""")
def cost_range(spark: SparkSession, d: str) -> DataFrame:
    low, high = parsing.cost_range(F.col("cost_mentioned"))
    return table(spark, d, "extracted_entities").where("cost_mentioned is not null").select("cost_mentioned").distinct().select("cost_mentioned", low.alias("low"), high.alias("high"))


@register("""select c_mktsegment || '_' || case when c_acctbal < 0 then 'budget' when c_acctbal < 5000 then 'mid-range' else 'luxury' end as profile_key, count(*) as n from customer group by 1""")
def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("c_acctbal") < 0, "budget").when(F.col("c_acctbal") < 5000, "mid-range").otherwise("luxury")
    return table(spark, d, "customer").groupBy(F.concat_ws("_", "c_mktsegment", tier).alias("profile_key")).agg(F.count("*").alias("n"))


@register(f"""with l as (select distinct location from extracted_entities where location is not null) select location, trim(regexp_replace(regexp_replace(translate(lower(regexp_replace(location, '[,.\\-]', ' ', 'g')), '{MARKED}', '{PLAIN}'), '[^a-z0-9\\s\\-'']', '', 'g'), '\\s+', ' ', 'g')) as normalized from l""")
def normalized_locations(spark: SparkSession, d: str) -> DataFrame:
    """Every typed location, marks and other scripts included, in its normal form."""
    rows = table(spark, d, "extracted_entities").where("location is not null").select("location").distinct()
    return rows.select("location", normalize_location(F.col("location")).alias("normalized"))


# Currencies as they are named behind an amount, and what one is in baht.
_RATES = {"baht": 1.0, "thb": 1.0, "usd": 35.0, "dollar": 35.0, "euro": 38.0, "eur": 38.0, "$": 35.0, "฿": 1.0, "€": 38.0}
_AMOUNT = r"(\d+[\d,]*\.?\d*)\s*(baht|thb|usd|dollar|euro|eur|\$|฿|€)"


@register(f"""with t as (select mention_id, lower(replace(coalesce(cost_mentioned, ''), 'marks', case mention_id % 3 when 0 then 'baht' when 1 then 'USD' else '€' end) || ' ' || coalesce(experience, '')) as x from (select distinct on (mention_id) * from extracted_entities)),
a as (select mention_id, unnest(regexp_extract_all(x, '{_AMOUNT}', 1)) as n, unnest(regexp_extract_all(x, '{_AMOUNT}', 2)) as c from t) select mention_id, count(*) as amounts, round(min(v), 4) as least, round(max(v), 4) as most, round(avg(v), 4) as mean from
(select mention_id, replace(n, ',', '')::double * case c when 'usd' then 35.0 when 'dollar' then 35.0 when '$' then 35.0 when 'eur' then 38.0 when 'euro' then 38.0 when '€' then 38.0 else 1.0 end::double as v from a) group by 1""")
def cost_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts named with a currency, in baht by fixed rates: how many, least, most, mean."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    # the tables know one currency; three stand in for it
    unit = F.when(F.col("mention_id") % 3 == 0, "baht").when(F.col("mention_id") % 3 == 1, "USD").otherwise("€")
    x = F.lower(F.concat(F.replace(F.coalesce("cost_mentioned", F.lit("")), F.lit("marks"), unit), F.lit(" "), F.coalesce("experience", F.lit(""))))
    rate = F.create_map(*[F.lit(v) for pair in _RATES.items() for v in pair])
    value = lambda n, c: F.regexp_replace(n, ",", "").cast("double") * F.element_at(rate, c)
    both = F.zip_with(F.regexp_extract_all(x, F.lit(_AMOUNT), F.lit(1)), F.regexp_extract_all(x, F.lit(_AMOUNT), F.lit(2)), value)
    v = m.select("mention_id", F.explode(both).alias("v")).groupBy("mention_id")
    return v.agg(F.count("*").alias("amounts"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"), F.round(F.avg("v"), 4).alias("mean"))


@register(r"""select coalesce(lang, '') as lang, count(*) as documents, sum(ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * case when lang in ('hi', 'th') then 2.0 when lang = 'id' then 1.5 else 1.33 end))::bigint as tokens from documents where text is not null group by 1""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Tokens estimated from words, by a ratio for each kind of language."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    ratio = F.when(F.col("lang").isin("hi", "th"), 2.0).when(F.col("lang") == "id", 1.5).otherwise(1.33)
    return table(spark, d, "documents").where("text is not null").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(F.ceil(words * ratio)).cast("long").alias("tokens"))
