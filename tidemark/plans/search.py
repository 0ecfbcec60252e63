"""Search, fusion and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scores, search
from tidemark.plans.catalog import register
from tidemark.session import table

_COS = "list_cosine_similarity(e.embedding::double[], q.v)"
_Q = "(select embedding::double[] as v from embeddings where vec_id = (select min(vec_id) from embeddings))"
TERMS = ["market", "bridge", "soup", "train"]
_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def _query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.min_by("embedding", "vec_id").alias("q"))


@register(f"select vec_id, round({_COS}, 6) as similarity from embeddings e, {_Q} q where label in (1, 3, 5) order by 2 desc, 1 limit 20")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query(spark, d), 20, F.col("label").isin(1, 3, 5))


@register(f"select vec_id, round({_COS}, 6) as similarity from embeddings e, {_Q} q where vec_id > (select min(vec_id) from embeddings) order by 2 desc, 1 limit 10")
def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    first = v.agg(F.min("vec_id").alias("_first"))
    return search.knn(v.join(F.broadcast(first)).where("vec_id > _first"), "vec_id", "embedding", _query(spark, d), 10)


@register(f"select doc_id, round(len(list_filter({_TERMS}, lambda t: contains(lower(text), t))) / {len(TERMS)}.0, 6) as score from documents where text is not null")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(search.keyword_score(F.col("text"), TERMS), 6).alias("score"))


@register(f"""with a as (select vec_id as id, row_number() over (order by round({_COS}, 6) desc, vec_id) - 1 as r from embeddings e, {_Q} q qualify r < 50),
b as (select doc_id as id, row_number() over (order by round(len(list_filter({_TERMS}, lambda t: contains(lower(text), t))) / {len(TERMS)}.0, 6) desc, doc_id) - 1 as r from documents where text is not null qualify r < 50)
select id, round(sum(1.0 / (60 + r)), 6) as score from (from a union all from b) group by 1""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    near = search.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query(spark, d), 50).withColumnRenamed("vec_id", "id")
    words = keyword_score(spark, d).withColumnRenamed("doc_id", "id")
    return search.rrf([search.ranks(near, "id", "similarity", 50), search.ranks(words, "id", "score", 50)], "id")


@register("""with m as (select entity_name, avg(rating) as r, count(*) as n, avg(confidence_score) as s from (select distinct on (mention_id) * from extracted_entities) where entity_name is not null group by 1)
select entity_name, round(0.4 * s + 0.3 * r / 5 + 0.2 * least(ln(1 + n) / 3, 1) + 0.1 * 0.5, 3) as relevance from m where r is not null""")
def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("entity_name is not null").groupBy("entity_name")
    m = m.agg(F.avg("rating").alias("r"), F.count("*").alias("n"), F.avg("confidence_score").alias("s")).where("r is not null")
    return m.select("entity_name", scores.relevance(F.col("s"), F.col("r"), F.col("n"), F.lit(0.5)).alias("relevance"))


@register("""with c as (select entity_no, confidence_score as s, 1 + entity_no % 5 as r, total_mentions as n, entity_no % 80 as km from canonical_entities)
select entity_no, 'balanced' as strategy, round(0.4 * s + 0.3 * r / 5 + 0.3 * least(n / 100.0, 1), 6) as score from c union all select entity_no, 'quality', round(0.3 * s + 0.6 * r / 5 + 0.1 * least(n / 100.0, 1), 6) from c
union all select entity_no, 'popular', round(0.3 * s + 0.1 * r / 5 + 0.6 * least(n / 100.0, 1), 6) from c union all select entity_no, 'distance', round(0.5 * s + 0.5 * greatest(1 - km / 50.0, 0), 6) from c""")
def rerank_strategies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_entities")
    s, r, n, km = F.col("confidence_score"), 1 + F.col("entity_no") % 5, F.col("total_mentions"), F.col("entity_no") % 80
    every = F.array(*[F.struct(F.lit(k).alias("strategy"), F.round(search.rerank(k, s, r, n, km), 6).alias("score")) for k in ("balanced", "quality", "popular", "distance")])
    return c.select("entity_no", F.inline(every))


@register("""with s as (select doc_id % 50 as id, lang as profile, avg(n_chars) as score from documents where lang in ('en', 'es', 'de') group by all), m as (select count(distinct profile) - 1 as m from s)
select id, round(sum(case when profile = 'en' then 0.7 else 0.3 / m end * score), 6) as score from s, m group by 1""")
def profile_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("lang").isin("en", "es", "de")).groupBy((F.col("doc_id") % 50).alias("id"), F.col("lang").alias("profile")).agg(F.avg("n_chars").alias("score"))
    return search.fuse_profiles(rows, "id", "profile", "en", "score")


@register("""with c as (select city, sum(total_mentions) as s from canonical_entities where city is not null group by 1 order by 2 desc, 1 limit 5), b as (select *, greatest(1, cast(floor(10 * s / sum(s) over ()) as int)) as base from c)
select city, case when row_number() over (order by s desc, city) = 1 then greatest(1, base + 10 - sum(base) over ()) else base end::int as days from b""")
def city_days(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "canonical_entities").where("city is not null").groupBy("city").agg(F.sum("total_mentions").alias("s")).orderBy(F.desc("s"), "city").limit(5)
    return search.allocate_days(top, "city", "s", 10)


@register("""select p_partkey, case when p_retailprice < 1000 then 'budget' when p_retailprice < 1400 then 'mid-range' else 'luxury' end as price_class,
case when p_size < 10 then 'near' when p_size < 25 then 'walkable' else 'far' end as distance_class, p_name || ' (' || p_brand || ')' as explanation from part""")
def enrichment_bands(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.when(p < 1000, "budget").when(p < 1400, "mid-range").otherwise("luxury").alias("price_class"),
        F.when(n < 10, "near").when(n < 25, "walkable").otherwise("far").alias("distance_class"), F.format_string("%s (%s)", "p_name", "p_brand").alias("explanation"),
    )


@register("""select entity_no, round(0.6 * confidence_score + 0.4 * (0.7 * (entity_no % 10) / 10.0 + 0.3), 6) as vibe_score, round(least(1, 0.6 * 5 / 10 + 0.2 * confidence_score + 0.1 + case when total_mentions < 5 then 0.15 else 0 end), 6) as merged from canonical_entities""")
def vibe_rerank(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("confidence_score"), F.col("entity_no") % 10
    gem = F.when(F.col("total_mentions") < 5, 0.15).otherwise(0.0)
    return table(spark, d, "canonical_entities").select(
        "entity_no", F.round(0.6 * c + 0.4 * (0.7 * k / 10.0 + 0.3), 6).alias("vibe_score"), F.round(F.least(F.lit(1.0), 0.6 * 5 / 10 + 0.2 * c + 0.1 + gem), 6).alias("merged")
    )
