"""Round trips through files, and streams against batch."""

import json

from pyspark.sql import functions as F

from tidemark.sources import lake
from tidemark.streaming import events
from tidemark.session import table


def test_jsonl_round_trip_with_broken_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "items": [{"n": "x"}, {"n": "y"}]}\n\n{broken\n{"id": 2, "items": []}\n')
    rows = lake.read_jsonl(spark, str(tmp_path), "id int, items array<struct<n: string>>").cache()
    assert rows.where("_corrupt_record is not null").count() == 1 and rows.where("id is not null").count() == 2
    nested = lake.read_nested(spark, str(tmp_path), "id int, items array<struct<n: string>>", "items", ["id"])
    assert sorted(map(tuple, nested.collect())) == [(1, "x"), (1, "y")]


def test_latest_snapshot_and_listing(spark, tmp_path):
    for k, name in enumerate(("entities_all_1.jsonl", "entities_all_2.jsonl")):
        (tmp_path / name).write_text(json.dumps({"v": k}) + "\n")
        __import__("os").utime(tmp_path / name, (1_700_000_000 + 100 * k,) * 2)
    assert [r.v for r in lake.latest_snapshot(spark, str(tmp_path), "v int").collect()] == [1]
    assert lake.file_listing(spark, str(tmp_path)).count() == 2


def test_url_list_fan_out_csv_and_geojson(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# no\n\nhttps://a.example\n")
    assert [r.url for r in lake.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.example"]
    rows = spark.createDataFrame([(1, "New Town/East", 1.5, 2.5), (2, None, None, None)], "id int, city string, lat double, lon double")
    lake.fan_out(rows, str(tmp_path / "out"), {"by_city": "city"})
    assert {p.name for p in (tmp_path / "out/by_city").iterdir() if p.is_dir()} == {"key=new_town_east", "key=unknown"}
    assert spark.read.json(str(tmp_path / "out/all")).count() == 2
    feature = json.loads(lake.geojson(rows, "id", "city", "lat", "lon").first().feature)
    assert feature["geometry"]["coordinates"] == [2.5, 1.5]
    stages = rows.select("id", F.create_map(F.lit("crawl"), F.lit("complete"), F.lit("index"), F.lit("failed")).alias("stages"))
    lake.write_stages_csv(stages, str(tmp_path / "csv"), "id", "stages")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_streams_equal_batch(spark, small, tmp_path):
    batch = table(spark, small, "events")
    batch.unionByName(batch.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), batch.schema)
    events.run_available(events.once_per_id(stream, "60 days"), str(tmp_path / "c1"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    events.run_to_table(events.hourly_counts(events.event_stream(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "out")).schema)), "hourly", str(tmp_path / "c2"))
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, want.collect()))


def test_broken_lines_are_counted_and_sources_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "items": [{"n": "x"}]}\n\n{broken\nalso broken\n')
    schema = "id int, items array<struct<n: string>>"
    assert [(r.file.rsplit("/", 1)[-1], r.errors) for r in lake.broken_documents(spark, str(tmp_path), schema).collect()] == [("a.jsonl", 2)]
    assert lake.read_nested(spark, str(tmp_path), schema, "items", ["id"], "origin").first().origin.endswith("a.jsonl")
    assert lake.file_listing(spark, str(tmp_path), 0).count() == 0


def test_metadata_paths_stats_and_moves(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A/b"), (2, None)], "id int, city string")
    lake.write_jsonl(rows, str(tmp_path / "m"), {"run": "7"})
    assert json.loads(next((tmp_path / "m/_metadata").glob("*.json")).read_text())["metadata"] == {"run": "7"}
    assert lake.batch_path("s", "tube", "video", "2025-03-04 05:06:07") == "s/raw/tube/video/2025-03/batch_20250304_050607"
    lake.fan_out(rows, str(tmp_path / "f"), {"by_city": "city"})
    stats = {(r.folder, r.key): r.n for r in spark.read.json(str(tmp_path / "f/stats")).collect()}
    assert stats == {("all", ""): 2, ("by_city", "a_b"): 1, ("by_city", "unknown"): 1}
    (tmp_path / "new").mkdir()
    (tmp_path / "new/x.json").write_text("{}")
    assert lake.move_processed(spark, [str(tmp_path / "new/x.json"), str(tmp_path / "new/none.json")], str(tmp_path / "done")) == 1
    assert (tmp_path / "done/x.json").exists() and not (tmp_path / "new/x.json").exists()


def test_keyed_tables_resets_and_bridges(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id long, at int, v string"
    lake.write_keyed(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "c")], schema), path, "id", "at")
    lake.write_keyed(spark.createDataFrame([(1, 2, "new"), (2, 0, "late"), (3, 1, "d")], schema), path, "id", "at")
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "new", 2: "b", 3: "d"}
    assert lake.backup(spark, path, str(tmp_path / "copy")) == 3
    t = spark.read.parquet(path)
    assert lake.insert_missing(t, spark.createDataFrame([(3, 9, "x"), (4, 9, "y"), (4, 9, "y")], schema), ["id"]).count() == 4
    left, counts = lake.without_keys({"t": t, "u": t.limit(0)}, "id", spark.createDataFrame([(1,), (None,)], "id long"))
    assert {r.table: r.rows for r in counts.collect()} == {"t": 1, "u": 0} and {r.id for r in left["t"].collect()} == {2, 3}
    tags = spark.createDataFrame([(1, ["x", None, "x"]), (2, None)], "id long, tags array<string>")
    assert [tuple(r) for r in lake.bridge(tags, "id", "tags", "tag").collect()] == [(1, "x")]
    places = spark.createDataFrame([("Old Bridge, Town , Land",), ("Town",), ("",), (None,)], "l string").select(*lake.split_location(F.col("l")))
    assert [tuple(r) for r in places.collect()] == [("Town", "Land"), ("Town", None), (None, None), (None, None)]


def test_collections_and_renderers(spark, tmp_path):
    c = lake.Collections(spark, str(tmp_path / "c"))
    assert c.names() == []
    rows = spark.createDataFrame([("Inn", 4.25, "good", 1.0, 2.0), (None, None, None, None, None)], "n string, s double, t string, lat double, lon double")
    c.create("a", rows)
    c.create("b", rows)
    assert c.names() == ["a", "b"] and c.count("a") == 2 and c.delete("a") and c.reset() == 1 and c.names() == []
    assert {r.line for r in lake.markdown(rows, "n", "s", "t").collect()} == {"### Inn\n\n**4.3 / 5**\n\ngood", "### (unnamed)"}
    assert {r[0] for r in rows.select(lake.map_link(F.col("lat"), F.col("lon"))).collect()} == {"geo:1.000000,2.000000", None}
    links = spark.createDataFrame([(1, 2, 1, "exact", 1.0, 1.0)], "a long, b long, tier int, method string, score double, confidence double")
    lake.audit_trail(links, str(tmp_path / "audit"))
    assert (tmp_path / "audit/method=exact").is_dir()
