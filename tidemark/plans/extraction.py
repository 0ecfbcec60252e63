"""Queries that read facts out of texts and prepare texts for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import extract, vibes
from tidemark.plans.catalog import register
from tidemark.session import table


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


_RATED = " || ".join(
    "list_transform(regexp_extract_all(lower(text), '" + p.replace("'", "''") + "', 1), lambda x: least(greatest((case x when 'five' then '5' when 'four' then '4' when 'three' then '3' else x end)::double / "
    + f"{top} * 5, 1.0), 5.0))" for p, top in extract.RATINGS
)


@register(f"with r as (select doc_id, {_RATED} as r from documents where text is not null) select doc_id, len(r)::int as ratings, round(list_avg(r), 6) as rating, list_max(r) as best from r")
def explicit_ratings(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").where("text is not null").select("doc_id", extract.said_ratings(F.col("text")).alias("r"))
    mean = F.try_divide(F.aggregate("r", F.lit(0.0), lambda s, x: s + x), F.nullif(F.size("r"), F.lit(0)))
    return r.select("doc_id", F.size("r").alias("ratings"), F.round(mean, 6).alias("rating"), F.array_max("r").alias("best"))


@register(f"""with h as (select doc_id, {_hits('lower(text)', extract.STRONG_PRAISE)} as sp, {_hits('lower(text)', extract.PRAISE)} as p, {_hits('lower(text)', extract.STRONG_BLAME)} as sb, {_hits('lower(text)', extract.BLAME)} as b from documents where text is not null),
n as (select *, sp + p + sb + b as n from h) select doc_id, round(case when n = 0 then 3.0 else least(greatest(3 + (2.0 * sp + p - 2 * sb - b) / n, 1), 5) end, 6)::double as rating, round(case when n = 0 then 0.2 else least(1.0, n / 5.0) end, 6)::double as confidence from n""")
def mood_ratings(spark: SparkSession, d: str) -> DataFrame:
    rating, confidence = extract.mood(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(rating, 6).alias("rating"), F.round(confidence, 6).alias("confidence"))


@register(f"""with m as (select distinct on (mention_id) * from extracted_entities), t as (select entity_name, mention_id, lower(experience) as x from m where entity_name is not null and experience is not null)
select entity_name, count(*) as experiences, bool_or({" or ".join(f"contains(x, '{w}')" for w in extract.BOOKING)}) as booking_required,
arg_min(regexp_extract(x, '(\\d+)\\s*(day|week|month)', 1) || ' ' || regexp_extract(x, '(\\d+)\\s*(day|week|month)', 2) || 's ahead', mention_id) filter (regexp_matches(x, '(\\d+)\\s*(day|week|month)')) as lead_time from t group by 1""")
def logistics_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("entity_name is not null and experience is not null")
    x, lead = F.col("experience"), extract.lead_time(F.col("experience"))
    return m.groupBy("entity_name").agg(
        F.count("*").alias("experiences"), F.max(extract.needs_booking(x)).alias("booking_required"), F.min_by(lead, F.when(lead.isNotNull(), F.col("mention_id"))).alias("lead_time")
    )


@register("""select event_id, (json_extract_string(props, '$.k'))::int as k, props is not null as parsed from events""")
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Model answers around JSON: fenced, or bare among words; the object is cut out and read."""
    e = table(spark, d, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" Enjoy")))
    body = extract.fenced_json(answer)
    return e.select("event_id", F.from_json(body, "k int")["k"].alias("k"), body.isNotNull().alias("parsed"))


_LEVEL = "case when confidence_score >= 0.8 then 'High' when confidence_score >= 0.6 then ' medium' when confidence_score >= 0.4 then 'low' when confidence_score is null then 'n/a' else confidence_score::varchar end"


@register(f"""with t as (select entity_no, array_to_string(aliases, ' , ') as a, case entity_no % 4 when 0 then 'Yes' when 1 then ' no' when 2 then 'maybe' end as f, {_LEVEL} as l, confidence_score as c from canonical_entities)
select entity_no, coalesce(len(list_filter(list_transform(string_split(a, ','), lambda x: trim(x)), lambda x: x <> '')), 0)::int as parts, case entity_no % 4 when 0 then true when 1 then false end as flag,
case when c >= 0.8 then 0.9 when c >= 0.6 then 0.6 when c >= 0.4 then 0.3 when c is null then 0.5 else c end::double as confidence from t""")
def tolerant_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_entities")
    n, s = F.col("entity_no") % 4, F.col("confidence_score")
    flag = F.when(n == 0, "Yes").when(n == 1, " no").when(n == 2, "maybe")
    level = F.when(s >= 0.8, "High").when(s >= 0.6, " medium").when(s >= 0.4, "low").when(s.isNull(), "n/a").otherwise(s.cast("string"))
    parts = extract.as_list(F.when(F.col("aliases").isNotNull(), F.array_join("aliases", " , ")))
    return c.select("entity_no", F.size(parts).alias("parts"), extract.as_flag(flag).alias("flag"), extract.as_confidence(level).alias("confidence"))


CORRECTIONS = [("harbor", "harbour"), ("centre", "center"), ("gonna", "going to"), ("wanna", "want to"), ("ok", "okay")]


def _corrected(c: str) -> str:
    for a, b in CORRECTIONS:
        c = f"regexp_replace({c}, '\\b{a}\\b', '{b}', 'gi')"
    return c


@register(f"""with t as (select distinct on (video_id, segment_index) video_id, segment_index, text from transcripts where text is not null order by video_id, segment_index, text), c as (select *, {_corrected('text')} as fixed from t)
select video_id, count(*) as segments, count(*) filter (fixed <> text) as corrected, sum(length(fixed) - length(text))::bigint as grown from c group by 1""")
def corrected_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary corrections of every segment; the old text stays where nothing changed."""
    t = table(spark, d, "transcripts").where("text is not null").groupBy("video_id", "segment_index").agg(F.min("text").alias("text"))
    c = t.withColumn("fixed", extract.correct(F.col("text"), CORRECTIONS))
    grown = F.sum(F.length("fixed") - F.length("text")).cast("long")
    return c.groupBy("video_id").agg(F.count("*").alias("segments"), F.count_if(F.col("fixed") != F.col("text")).alias("corrected"), grown.alias("grown"))


_PRICE = "repeat('$', (1 + entity_no % 4)::int)"


def _vibe_sql(kind: str, price: str, text: str) -> str:
    cells = []
    for m in vibes.MOODS:
        base = "greatest(0.0" + "".join(f", case when {kind} = '{k}' then {v[m]} else 0.0 end" for k, v in vibes.OF_KIND.items() if m in v)
        if m in ("budget", "luxury"):
            base += "".join(f", case when {price} = '{level}' then {pair[m == 'luxury']} else 0.0 end" for level, pair in vibes.OF_PRICE.items())
        words = vibes.WORDS[m]
        s = f"least(1.0::double, {_hits(text, words)} / (0.3 * {len(words)})::double)"
        cells.append(f"case when {s} > 0 then 0.4 * {base}) + 0.6 * {s} else {base}) end::double")
    return "[" + ", ".join(cells) + "]"


_SAID = "(with m as (select distinct on (mention_id) * from extracted_entities) select entity_name, string_agg(experience, ' ' order by mention_id) as x from m where experience is not null group by 1)"
_VIBES = f"select entity_no, entity_type, {_vibe_sql('entity_type', _PRICE, "lower(coalesce(x, ''))")} as v from canonical_entities c left join {_SAID} s on s.entity_name = c.canonical_name"


def _entity_vibes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("experience is not null and entity_name is not null")
    x = m.groupBy(F.col("entity_name").alias("canonical_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mention_id", "experience"))), lambda r: r["experience"]), " ").alias("x"))
    c = table(spark, d, "canonical_entities").join(x, "canonical_name", "left")
    price = F.repeat(F.lit("$"), (1 + F.col("entity_no") % 4).cast("int"))
    return c.select("entity_no", "entity_type", vibes.of_entity(F.col("entity_type"), price, F.col("x")).alias("v"))


@register(f"with v as ({_VIBES}) select entity_no, " + ", ".join(f"round(v[{k + 1}], 6) as {m}" for k, m in enumerate(vibes.MOODS)) + " from v")
def entity_vibes(spark: SparkSession, d: str) -> DataFrame:
    return _entity_vibes(spark, d).select("entity_no", *[F.round(F.col("v")[k], 6).alias(m) for k, m in enumerate(vibes.MOODS)])


QUERY = "a quiet garden and a museum, then street food at the night market with a cocktail"
_QV = "[" + ", ".join(f"least(1.0::double, {_hits(f"'{QUERY}'", vibes.WORDS[m])} / (0.2 * {len(vibes.WORDS[m])})::double)" for m in vibes.MOODS) + "]"
_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"


@register(f"""with v as ({_VIBES}), q as (select {_QV} as q), s as (select entity_no, v, q, list_dot_product(v, q) / nullif({_NORM} * sqrt(list_sum(list_transform(q, lambda x: x * x))), 0) as c from v, q)
select entity_no, round(coalesce(c, 0), 6) as fit, array_to_string(list_filter({_list(vibes.MOODS)}, lambda m, i: abs(v[i] - q[i]) > 0.5), ',') as mismatched from s""")
def vibe_fit(spark: SparkSession, d: str) -> DataFrame:
    v = _entity_vibes(spark, d).withColumn("q", vibes.of_query(F.lit(QUERY)))
    return v.select("entity_no", F.round(vibes.fit(F.col("v"), F.col("q")), 6).alias("fit"), F.array_join(vibes.mismatches(F.col("v"), F.col("q")), ",").alias("mismatched"))


KEYWORDS = ["place", "visit", "city", "experience", "known"]


@register(f"""with m as (select distinct on (mention_id) * from extracted_entities), x as (select entity_name, string_agg(experience, ' ' order by mention_id) as said, count(*) as n from m where experience is not null group by 1),
t as (select entity_no, concat_ws('. ', case when length(trim(canonical_name)) > 0 then canonical_name || ' is a place to visit' end, case when length(trim(city)) > 0 then 'City: ' || city end, case when len(aliases) > 0 then 'Also known as ' || array_to_string(aliases, ', ') end, case when length(trim(said)) > 0 then said end) as text from canonical_entities c left join x on entity_name = canonical_name)
select entity_no, md5(text) as text_hash, array_to_string(list_filter([case when w < 50 then 'too_short' end, case when w > 1000 then 'too_long' end, case when h > 3 then 'placeholders' end, case when k < 2 then 'off_topic' end], lambda x: x is not null), ',') as issues
from (select *, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w, len(regexp_extract_all(lower(text), '(unknown|n/a|none)', 1)) as h, {_hits('lower(text)', KEYWORDS)} as k from t)""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of each entity that is to be embedded, by hash, with what is wrong with it."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("experience is not null and entity_name is not null")
    x = m.groupBy(F.col("entity_name").alias("canonical_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mention_id", "experience"))), lambda r: r["experience"]), " ").alias("said"))
    c = table(spark, d, "canonical_entities").join(x, "canonical_name", "left")
    also = F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as "), F.array_join("aliases", ", ")))
    named = F.when(F.length(F.trim("canonical_name")) > 0, F.concat("canonical_name", F.lit(" is a place to visit")))
    city = F.when(F.length(F.trim("city")) > 0, F.concat(F.lit("City: "), "city"))
    text = extract.sentences(named, city, also, F.col("said"))
    return c.select("entity_no", F.md5(text).alias("text_hash"), F.array_join(extract.text_issues(text, KEYWORDS), ",").alias("issues"))


@register("""select entity_no, array_to_string(list_filter([case when canonical_name is not null then 'canonical_name' end, case when entity_type is not null then 'entity_type' end, case when city is not null then 'city' end, case when country is not null then 'country' end,
case when latitude is not null then 'latitude' end, case when confidence_score is not null then 'confidence_score' end, case when len(aliases) > 0 then 'aliases' end], lambda x: x is not null), ',') as fields,
case when len(aliases) > 0 then '["' || array_to_string(list_transform(list_slice(aliases, 1, 5), lambda x: replace(x, '"', '\\"')), '","') || '"]' end as aliases from canonical_entities""")
def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What goes beside a vector: fields without nulls, lists as JSON of five entries at most."""
    c = table(spark, d, "canonical_entities")
    flat = ("canonical_name", "entity_type", "city", "country", "latitude", "confidence_score")
    aliases = F.when(F.size("aliases") > 0, F.to_json(F.slice("aliases", 1, 5)))
    pairs = F.create_map(*[x for n in flat for x in (F.lit(n), F.col(n).cast("string"))], F.lit("aliases"), aliases)
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull())
    return c.select("entity_no", F.array_join(F.map_keys(kept), ",").alias("fields"), F.try_element_at(kept, F.lit("aliases")).alias("aliases"))


@register("""with m as (select distinct on (mention_id) * from extracted_entities), v as (select video_id, count(*) as n, avg(confidence_score) as c, max(timestamp_end) > 1200 as long from m where video_id is not null group by 1),
t as (select *, case when coalesce(long, false) then 15 else 3 end as least from v)
select video_id, n as entities, case when n >= 2 * least and c >= 0.7 then 'high' when n >= least and c >= 0.5 then 'medium' else 'low' end as quality, not (n >= least and coalesce(c >= 0.5, false)) and (n < least or coalesce(c < 0.3, true)) as escalate from t""")
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each video's extraction, and whether a better pass is due; long videos must yield more."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where("video_id is not null")
    v = m.groupBy("video_id").agg(F.count("*").alias("entities"), F.avg("confidence_score").alias("c"), F.coalesce(F.max("timestamp_end") > 1200, F.lit(False)).alias("long"))
    least, n, c = F.when(F.col("long"), 15).otherwise(3), F.col("entities"), F.col("c")
    good = (n >= least) & F.coalesce(c >= 0.5, F.lit(False))
    quality = F.when((n >= 2 * least) & (c >= 0.7), "high").when(good, "medium").otherwise("low")
    return v.select("video_id", "entities", quality.alias("quality"), (~good & ((n < least) | F.coalesce(c < 0.3, F.lit(True)))).alias("escalate"))


@register("""with m as (select distinct on (mention_id) * from extracted_entities) select mention_id, confidence_score from m where confidence_score between 0.1 and 1.0""")
def profile_gate(spark: SparkSession, d: str) -> DataFrame:
    """Profiles whose confidence is set and lies between 0.1 and 1."""
    return table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).where(F.col("confidence_score").between(0.1, 1.0)).select("mention_id", "confidence_score")


@register("""with m as (select distinct on (mention_id) * from extracted_entities), f as (select * from m where coalesce(entity_type, '') <> 'unknown' and sentiment in ('positive', 'negative'))
select coalesce(entity_type, '') as entity_type, sentiment, count(*) as mentions, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from f group by 1, 2""")
def mention_view(spark: SparkSession, d: str) -> DataFrame:
    """Counts and percentages by kind and feeling, of mentions filtered by both."""
    m = table(spark, d, "extracted_entities").dropDuplicates(["mention_id"]).withColumn("entity_type", F.coalesce("entity_type", F.lit("")))
    g = m.where("entity_type <> 'unknown' and sentiment in ('positive', 'negative')").groupBy("entity_type", "sentiment").agg(F.count("*").alias("mentions"))
    return g.withColumn("percent", F.round(100.0 * F.col("mentions") / F.sum("mentions").over(Window.partitionBy(F.lit(1))), 4))
