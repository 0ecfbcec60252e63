"""Histories, trends, quotas, chunks, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks, history
from tidemark.operators.filters import latest
from tidemark.plans.catalog import register
from tidemark.session import table

_DAYS = 14
_TREND = f"""(with m as (select max(ts) as t from events), e as (select user_id, event_type, ts, event_id, value from events, m where ts >= m.t - interval {_DAYS} day and value is not null)
select user_id, event_type, count(*) as points, arg_min(value, (ts, event_id)) as first_value, arg_max(value, (ts, event_id)) as last_value from e group by all having count(*) >= 2)"""


@register(f"""select user_id, event_type, points, round(last_value - first_value, 6) as change, round(case when first_value = 0 then 0 else 100 * (last_value - first_value) / first_value end, 4) as change_pct,
case when last_value > first_value then 'increasing' when last_value < first_value then 'decreasing' else 'stable' end as trend from {_TREND}""")
def score_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.trend(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "value", _DAYS)


@register(f"""select event_type, user_id, round(last_value - first_value, 6) as change from {_TREND} where last_value - first_value >= 10 qualify row_number() over (partition by event_type order by round(last_value - first_value, 6) desc, user_id) <= 10""")
def trending_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = history.trend(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "value", _DAYS)
    return latest(rows.where("change >= 10").select("event_type", "user_id", "change"), "event_type", [F.desc("change"), F.col("user_id")], 10)


@register(f"""select event_type, user_id, round(last_value - first_value, 6) as change from {_TREND} where last_value - first_value <= -10 qualify row_number() over (partition by event_type order by round(last_value - first_value, 6), user_id) <= 10""")
def declining_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = history.trend(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "value", _DAYS)
    return latest(rows.where("change <= -10").select("event_type", "user_id", "change"), "event_type", [F.asc("change"), F.col("user_id")], 10)


@register("""select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20""")
def history_retention(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).drop("ts")


@register("""with q(entity_type, quota) as (values ('attraction', 30), ('restaurant', 25), ('activity', 25), ('hotel', 10), ('shopping', 10)),
r as (select entity_no, c.entity_type, confidence_score as score, row_number() over (partition by c.entity_type order by confidence_score desc, entity_no) as pos, quota from canonical_entities c left join q using (entity_type)),
p as (select entity_no, entity_type, score, case when pos <= coalesce(quota, 0) then 0 else 1 end as late from r)
select entity_no, entity_type, score from p order by late, score desc, entity_no limit 60""")
def type_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    quota = {"attraction": 30, "restaurant": 25, "activity": 25, "hotel": 10, "shopping": 10}
    rows = table(spark, d, "canonical_entities").select("entity_no", "entity_type", F.col("confidence_score").alias("score"))
    return history.quota_sample(rows, "entity_type", quota, "score", "entity_no", 60)


@register("""with r as (select entity_no, entity_type, confidence_score as s, row_number() over (partition by entity_type order by confidence_score desc, entity_no) - 1 as i, count(*) over (partition by entity_type) as n from canonical_entities)
select entity_no, entity_type, round(case when n > 2 and i >= 2 then greatest(0, s - 0.3 * (i - 1) / 10.0) else s end, 6) as score from r""")
def redundancy_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_entities").select("entity_no", "entity_type", F.col("confidence_score").alias("s"))
    return history.penalised(rows, "entity_type", "s", "entity_no").select("entity_no", "entity_type", F.round("score", 6).alias("score"))


@register("""select entity_no, entity_type || '_' || substr(regexp_replace(lower(city), '[^a-z0-9]', '', 'g'), 1, 15) || '_' || lpad(cast(row_number() over (partition by entity_type, city order by entity_no) as varchar), 3, '0') as new_id from canonical_entities where city is not null""")
def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    return history.sequence_ids(table(spark, d, "canonical_entities").where("city is not null"), "entity_type", "city", "entity_no")


@register("""with e as (select user_id, event_id, event_type, lag(event_type) over w as a, lead(event_type) over w as c from events window w as (partition by user_id order by ts, event_id))
select user_id, count(*) as ping_pongs from e where a = c and a <> event_type group by 1""")
def ping_pong(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumns({"a": F.lag("event_type").over(w), "c": F.lead("event_type").over(w)})
    return rows.where("a = c and a <> event_type").groupBy("user_id").agg(F.count("*").alias("ping_pongs"))


_SEGMENTS = "(select distinct on (video_id, segment_index) video_id, segment_index, start, duration from transcripts where start is not null and duration is not null)"


@register(f"""with s as (select video_id, start as a, start + duration as b from {_SEGMENTS}), e as (select video_id, max(b) as last from s group by 1),
w as (select video_id, unnest(generate_series(0, cast(floor(last) as bigint), 240)) as w from e)
select w.video_id, w.w as window_start, count(*) as segments from w join s on s.video_id = w.video_id and s.a < w.w + 300 and s.b > w.w group by all""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").where("start is not null and duration is not null").dropDuplicates(["video_id", "segment_index"])
    return chunks.fixed_windows(rows, "video_id", "start", "duration", 300, 240)


@register("""with w as (select doc_id, regexp_extract_all(text, '[^ ]+') as w from documents where text is not null), c as (select doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 40)) as p from w)
select doc_id, p as word_from, len(w[p + 1:p + 50])::int as words, md5(array_to_string(w[p + 1:p + 50], ' ')) as digest from c""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.word_windows(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 50, 40)


@register(f"""with s as (select video_id, segment_index, start, lag(start) over (partition by video_id order by segment_index) as p from {_SEGMENTS})
select video_id, count(*) as segments, count(*) filter (start < p) as out_of_order from s group by 1""")
def ordered_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcripts").where("start is not null and duration is not null").dropDuplicates(["video_id", "segment_index"])
    p = F.lag("start").over(Window.partitionBy("video_id").orderBy("segment_index"))
    return rows.withColumn("p", p).groupBy("video_id").agg(F.count("*").alias("segments"), F.count_if(F.col("start") < F.col("p")).alias("out_of_order"))


@register("""select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = rows.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@register("""with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g) select user_id, min(ts) as begins, count(*) as events from s group by user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = rows.groupBy("user_id", F.session_window("t", "12 hours").alias("w")).agg(F.count("*").alias("events"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begins"), "events")


@register()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 120 to 420 seconds cut at topic shifts; a sequential fold, checked against brute force in the tests."""
    rows = table(spark, d, "transcripts").where("start is not null and text is not null").dropDuplicates(["video_id", "segment_index"])
    return chunks.semantic(rows)
