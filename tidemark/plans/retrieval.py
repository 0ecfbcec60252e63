"""Retrieval queries: filter algebra, fallbacks, hybrid and full retrieval, browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vector import relevance_percent
from tidemark.operators import retrieval, search
from tidemark.plans.catalog import register
from tidemark.session import table

_COS = "list_cosine_similarity(e.embedding::double[], q.v)"
_Q = "(select embedding::double[] as v from embeddings where vec_id = (select min(vec_id) from embeddings))"
_PRICE = "repeat('$', (1 + entity_no % 4)::int)"


def _query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.min_by("embedding", "vec_id").alias("q"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").withColumn("price_level", F.repeat(F.lit("$"), (1 + F.col("entity_no") % 4).cast("int")))


@register(f"""select entity_no, {_PRICE} as price_level from canonical_entities where confidence_score >= 0.6 and entity_type in ('hotel', 'restaurant', 'museum', 'cafe', 'attraction') and (country is not null and (latitude > 0 or total_mentions > 10)) and {_PRICE} in ('$$', '$$$')""")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    where = {
        "$and": [
            {"confidence_score": {"$gte": 0.6}}, {"entity_type": {"$in": ["hotel", "restaurant", "museum", "cafe", "attraction"]}},
            {"country": {"$ne": ""}, "$or": [{"latitude": {"$gt": 0.0}}, {"total_mentions": {"$gt": 10}}]}, retrieval.budget_levels("mid-range"),
        ]
    }
    return _entities(spark, d).where(retrieval.predicate(where)).select("entity_no", "price_level")


def _fallback_sql(wanted: str) -> str:
    return f"(select entity_no, city from canonical_entities where contains(lower(city), '{wanted}') and (lower(city) = '{wanted}' or not exists (select 1 from canonical_entities where lower(city) = '{wanted}')))"


@register(f"with q as (select min(lower(city)) as c from canonical_entities) select 'exact' as asked, entity_no from canonical_entities, q where lower(city) = c union all select 'part', entity_no from {_fallback_sql('an')}")
def city_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a city named exactly, and of one named in part only."""
    e = _entities(spark, d)
    first = e.agg(F.min(F.lower("city"))).first()[0] or ""
    exact = retrieval.exact_then_contains(e, "city", first).select(F.lit("exact").alias("asked"), "entity_no")
    return exact.unionByName(retrieval.exact_then_contains(e, "city", "an").select(F.lit("part").alias("asked"), "entity_no"))


@register(f"""with s as (select vec_id, greatest(0, least(100, (1 - (1 - {_COS}) / 2) * 100)) as p from embeddings e, {_Q} q) select vec_id, round(p, 4) as relevance from s where p >= 55""")
def min_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose relevance to the query, as a percentage of the distance, is 55 at least."""
    from tidemark.functions.vector import cosine

    v = table(spark, d, "embeddings").join(F.broadcast(_query(spark, d)))
    p = relevance_percent(1 - cosine(F.col("embedding"), F.col("q")))
    return v.select("vec_id", p.alias("p")).where("p >= 55").select("vec_id", F.round("p", 4).alias("relevance"))


_MENTIONED = "(select label, count(*) as mentions from embeddings group by 1)"


@register(f"with t as (select vec_id, label, round({_COS}, 6) as similarity from embeddings e, {_Q} q order by 3 desc, 1 limit 40) select vec_id, similarity, mentions from t join {_MENTIONED} using (label) order by mentions desc, similarity desc, vec_id limit 15")
def trending_near(spark: SparkSession, d: str) -> DataFrame:
    """The 40 nearest, of which the 15 mentioned most."""
    v = table(spark, d, "embeddings")
    mentions = v.groupBy("label").agg(F.count("*").alias("mentions"))
    near = search.knn(v, "vec_id", "embedding", _query(spark, d), 40).join(v.select("vec_id", "label"), "vec_id").join(mentions, "label")
    return near.orderBy(F.desc("mentions"), F.desc("similarity"), "vec_id").limit(15).select("vec_id", "similarity", "mentions")


@register("select entity_no, canonical_name, (select count(*) from canonical_entities where entity_type is not null) as total from canonical_entities where entity_type is not null order by total_mentions desc, entity_no limit 20 offset 40")
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 20, with the true total."""
    rows = _entities(spark, d).where("entity_type is not null")
    return retrieval.page(rows, [F.desc("total_mentions"), F.col("entity_no")], 3, 20).select("entity_no", "canonical_name", "total")


@register("select entity_no, canonical_name from canonical_entities order by md5('qa:' || entity_no::varchar), entity_no limit 10")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.seeded_sample(_entities(spark, d), "entity_no", 10, "qa").select("entity_no", "canonical_name")


@register("""with recursive s as (select city as k, entity_no as id, coalesce(entity_type, 'unknown') as t, round(100 * confidence_score - total_mentions % 37, 4) as score from canonical_entities where city is not null and confidence_score is not null),
o as (select *, row_number() over (partition by k order by score desc, id) as pos from s),
r as (select k, pos, id, [t] as kept, score as last, true as keep from o where pos = 1 union all
select o.k, o.pos, o.id, case when list_count(list_filter(r.kept, lambda x: x = o.t)) >= 3 and o.score + 6 < 0.8 * r.last then r.kept else list_append(r.kept, o.t) end,
case when list_count(list_filter(r.kept, lambda x: x = o.t)) >= 3 and o.score + 6 < 0.8 * r.last then r.last else o.score end, not (list_count(list_filter(r.kept, lambda x: x = o.t)) >= 3 and o.score + 6 < 0.8 * r.last) from r join o on o.k = r.k and o.pos = r.pos + 1)
select k as city, id as entity_no, row_number() over (partition by k order by pos) as rank from r where keep""")
def diversified_results(spark: SparkSession, d: str) -> DataFrame:
    """Each city's results with at most three of a kind, further ones only where they compete."""
    e = _entities(spark, d).where("city is not null and confidence_score is not null")
    e = e.select("city", "entity_no", "entity_type", F.round(100 * F.col("confidence_score") - F.col("total_mentions") % 37, 4).alias("score"))
    return retrieval.diversified(e, "city", "entity_type", "score", "entity_no")


_BOTH = f"""a as (select vec_id as id, row_number() over (order by round({_COS}, 6) desc, vec_id) - 1 as r from embeddings e, {_Q} q where label < 6 qualify r < 50),
t as (select doc_id, round(len(list_filter(['market', 'bridge', 'soup', 'train'], lambda w: contains(lower(text), w))) / 4.0, 6) as s from documents where text is not null),
b as (select doc_id as id, row_number() over (order by s desc, doc_id) - 1 as r from t where s > 0 qualify r < 50)"""


@register(f"with {_BOTH} select id, coalesce(label, -1) as label, score from (select id, round(sum(1.0 / (60 + r)), 6) as score from (from a union all from b) group by 1) left join embeddings on vec_id = id order by score desc, id limit 20")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Filter, nearest vectors, keyword hits, rank fusion, the 20 best with their metadata."""
    v = table(spark, d, "embeddings")
    near = search.knn(v, "vec_id", "embedding", _query(spark, d), 50, retrieval.predicate({"label": {"$lt": 6}})).withColumnRenamed("vec_id", "id")
    words = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.round(search.keyword_score(F.col("text"), ["market", "bridge", "soup", "train"]), 6).alias("score"))
    fused = search.rrf([search.ranks(near, "id", "similarity", 50), search.ranks(words.where("score > 0"), "id", "score", 50)], "id")
    top = fused.orderBy(F.desc("score"), "id").limit(20)
    return top.join(v.select(F.col("vec_id").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "score")


@register("""with c as (select 'entities' as collection, entity_no as id, confidence_score as s from canonical_entities where confidence_score is not null union all select 'mentions', mention_id, confidence_score from (select distinct on (mention_id) * from extracted_entities) where confidence_score is not null
union all select 'snapshots', record_id, confidence_score from (select distinct on (record_id) * from canonical_snapshots) where confidence_score is not null) select collection, id, s as score from c qualify row_number() over (partition by collection order by s desc, id) <= 10""")
def search_collections(spark: SparkSession, d: str) -> DataFrame:
    """One search over several collections: the ten best of each, dispatched by name."""
    ids = {"entities": ("canonical_entities", "entity_no"), "mentions": ("extracted_entities", "mention_id"), "snapshots": ("canonical_snapshots", "record_id")}
    out = None
    for name, (source, row_id) in ids.items():
        rows = table(spark, d, source).dropDuplicates([row_id]).where("confidence_score is not null")
        best = rows.orderBy(F.desc("confidence_score"), row_id).limit(10).select(F.lit(name).alias("collection"), F.col(row_id).alias("id"), F.col("confidence_score").alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


@register("""with m as (select distinct on (mention_id) * from extracted_entities), t as (select min(tag) as a, max(tag) as b from (select unnest(tags) as tag from m)), c as (select list(city) as cs from (select distinct city from m where city is not null order by city limit 5))
select mention_id, list_contains(tags, a) and list_contains(tags, b) as every from m, t, c where list_contains(cs, city) and (list_contains(tags, a) or list_contains(tags, b))""")
def attribute_search(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in any of several cities that have any of two tags, and whether they have both."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"])
    tags = m.select(F.explode("tags").alias("tag")).agg(F.min("tag").alias("a"), F.max("tag").alias("b"))
    cities = m.where("city is not null").select("city").distinct().orderBy("city").limit(5)
    rows = m.join(F.broadcast(cities), "city", "left_semi").join(F.broadcast(tags))
    a, b = F.array_contains("tags", F.col("a")), F.array_contains("tags", F.col("b"))
    return rows.where(a | b).select("mention_id", (a & b).alias("every"))


_POOL = "select entity_no, coalesce(entity_type, '') as entity_type, confidence_score as s, total_mentions as n, entity_no % 4 as level from canonical_entities where confidence_score is not null"


@register(f"""with p as ({_POOL}), b as (select * from p where n > 12 order by s desc, entity_no limit 60), x as (select * from p where n <= 12 and (select count(*) from b) < 5 order by s desc, entity_no limit 40), u as (from b union all from x),
t as (select *, row_number() over (partition by entity_type order by s desc, entity_no) as turn from u), k as (select * from t order by turn, s desc, entity_no limit 20), f as (select entity_no, entity_type, round(0.7 * s + 0.3 * (entity_no % 10) / 10.0, 6) as relevance from k where level <= 2)
select *, row_number() over (order by relevance desc, entity_no) as rank from f""")
def full_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Broad retrieval with fallback, turns over kinds, budget, fit, relevance: the whole plan for k = 20."""
    e = _entities(spark, d).where("confidence_score is not null").withColumn("entity_type", F.coalesce("entity_type", F.lit("")))
    fit = (F.col("entity_no") % 10) / 10.0
    return retrieval.retrieval_plan(
        e.where("total_mentions > 12"), e.where("total_mentions <= 12"), "entity_no", "entity_type", "confidence_score", 20, F.col("entity_no") % 4 <= 2, fit, F.col("confidence_score")
    )


@register("""select v.video_id, e.mention_id from (select distinct on (mention_id) * from extracted_entities) e join (select distinct video_id from videos where duration_seconds > 300) v using (video_id) where e.entity_type in ('hotel', 'restaurant', 'museum') order by 1, 2 limit 100""")
def ready_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the finished videos, of some kinds only, the first hundred."""
    v = table(spark, d, "videos").where("duration_seconds > 300").select("video_id").distinct()
    e = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where(F.col("entity_type").isin("hotel", "restaurant", "museum"))
    return e.join(v, "video_id", "left_semi").select("video_id", "mention_id").orderBy("video_id", "mention_id").limit(100)


@register("select entity_no, canonical_name from canonical_entities where entity_type in ('hotel', 'museum') union all select entity_no, canonical_name from canonical_entities where entity_no in (3, 5, 8) and coalesce(entity_type, '') not in ('hotel', 'museum')")
def entities_by_kind_or_id(spark: SparkSession, d: str) -> DataFrame:
    """A scan by kind, and a look-up by id, as one set."""
    e = _entities(spark, d)
    return e.where(retrieval.predicate({"$or": [{"entity_type": {"$in": ["hotel", "museum"]}}, {"entity_no": {"$in": [3, 5, 8]}}]})).select("entity_no", "canonical_name")


@register(f"""with probe as (select vec_id, embedding::double[] as v from embeddings order by md5('probe:' || vec_id::varchar), vec_id limit 5), h as (select p.vec_id, arg_max(e.vec_id, (round(list_cosine_similarity(e.embedding::double[], p.v), 6), -e.vec_id)) as hit from probe p, embeddings e group by 1)
select (select count(*) from embeddings) as vectors, (select count(distinct len(embedding)) from embeddings) as sizes, (select count(*) filter (embedding is null) from embeddings) as missing, (select count(*) filter (hit = vec_id) from h) as self_hits""")
def collection_health(spark: SparkSession, d: str) -> DataFrame:
    """Size of the collection, widths of its vectors, missing ones, and how many of five probes find themselves."""
    from tidemark.functions.vector import cosine

    v = table(spark, d, "embeddings")
    probes = retrieval.seeded_sample(v, "vec_id", 5, "probe").select(F.col("vec_id").alias("p"), F.col("embedding").alias("q"))
    near = v.join(F.broadcast(probes)).select("p", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("s"))
    hit = near.groupBy("p").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("hit")).agg(F.count_if(F.col("hit") == F.col("p")).alias("self_hits"))
    sizes = v.agg(F.count("*").alias("vectors"), F.countDistinct(F.size("embedding")).alias("sizes"), F.count_if(F.col("embedding").isNull()).alias("missing"))
    return sizes.join(F.broadcast(hit))
