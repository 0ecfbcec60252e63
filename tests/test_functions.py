"""Expressions, kernels and operators on small hand-made rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import geohash, grid_cells, haversine_km
from tidemark.functions.similarity import fuzzy_name_score, indel_ratio, lcs_length, partial_ratio, ratio_udf, sequence_ratio
from tidemark.functions.text import normalize_entity_text, normalize_name, url_hash, video_id
from tidemark.functions.vector import cosine
from tidemark.operators import chunks, filters, grouping, history, incremental, pairs


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_similarity_kernels(spark):
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lcs_length(a, b) == brute_lcs(a, b)
    assert partial_ratio("pho", "wat pho temple") == 1.0 and indel_ratio("", "") == 1.0 and sequence_ratio("abcd", "abcd") == 1.0
    rows = spark.createDataFrame([("wat pho", "wat pho temple"), ("grand palace", "the grand palace"), ("x", "x"), ("", "x")], "a string, b string")
    got = [round(r.s, 4) for r in rows.select(fuzzy_name_score("a", "b", ratio_udf()).alias("s")).collect()]
    assert got == [0.5667, 0.7929, 1.0, 0.0]


def test_geohash_equals_bisection(spark):
    def encode(lat, lon, n):
        box, bits = [[-180.0, 180.0], [-90.0, 90.0]], ""
        for i in range(5 * n):
            lo, hi = box[i % 2]
            mid, v = (lo + hi) / 2, (lon, lat)[i % 2]
            bits += "1" if v >= mid else "0"
            box[i % 2] = [mid, hi] if v >= mid else [lo, mid]
        return "".join("0123456789bcdefghjkmnpqrstuvwxyz"[int(bits[k : k + 5], 2)] for k in range(0, 5 * n, 5))

    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(57.64911, 10.40744)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for n in (4, 7):
        got = [r.g for r in df.select(geohash(F.col("lat"), F.col("lon"), n).alias("g")).collect()]
        assert got == [encode(lat, lon, n) for lat, lon in points]
    assert got[-1] == "u4pruyd"


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.uniform(-70, 70) if k % 3 else rng.uniform(10, 10.2), rng.uniform(20, 20.3)) for k in range(300)], "k long, lat double, lon double")
    a, b = (df.withColumnsRenamed({"k": x, "lat": f"lat{x}", "lon": f"lon{x}"}) for x in "ab")
    km = haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb"))
    want = {(r.a, r.b) for r in a.crossJoin(b).where("a < b").where(km <= 8).collect()}
    assert {(r.a, r.b) for r in pairs.near_pairs(df, "k", "lat", "lon", 8.0).collect()} == want and want
    assert len(df.select(grid_cells(F.col("lat"), F.col("lon"), 5.0, True).alias("c")).first().c) == 9


def test_text_forms(spark):
    df = spark.createDataFrame([("  Café-Déjà  Vu! ", "The A Temple", "https://X.example/Watch?v=abcdefghijk#t")], "a string, b string, u string")
    r = df.select(normalize_entity_text(F.col("a")).alias("a"), normalize_name(F.col("b")).alias("b"), video_id(F.col("u")).alias("v"), url_hash(F.col("u")).alias("h")).first()
    assert (r.a, r.b, r.v, len(r.h)) == ("cafe-deja vu", "temple", "abcdefghijk", 8)
    urls = ["https://x.example/a", "https://x.example/a/", "HTTPS://X.EXAMPLE/a?q=1", "https://x.example/a#f"]
    assert spark.createDataFrame([(u,) for u in urls], "u string").select(url_hash(F.col("u")).alias("h")).distinct().count() == 1


def test_cosine_of_no_length_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]


def test_mode_name_ties(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "abc"), (2, "b"), (2, "a"), (3, None)], "g int, n string")
    assert {(r.g, r.n) for r in grouping.mode_name(rows, "g", "n").collect()} == {(1, "abc"), (2, "a")}


def test_three_failed_starts_give_five_retries(spark):
    ops = [(1, op, datetime(2025, 1, 1, k), k) for k, op in enumerate(["register", "start", "fail", "start", "fail", "start", "fail"])]
    r = incremental.replay(spark.createDataFrame(ops, "k int, op string, ts timestamp, i int"), "k", "op", "ts", "i").first()
    assert (r.status, r.starts, r.fails, r.retry_count) == ("failed", 3, 3, 5)


def test_trend_of_three_runs(spark):
    rows = [("e", datetime(2026, 1, d), d, v) for d, v in ((20, 0.5), (22, 0.7), (25, 0.85))] + [("one", datetime(2026, 1, 25), 1, 1.0), ("none", datetime(2026, 1, 25), 2, None)]
    got = history.trend(spark.createDataFrame(rows, "id string, ts timestamp, tie int, v double"), ["id"], "ts", "tie", "v", 30).collect()
    assert [(r.id, r.points, r.change, r.trend) for r in got] == [("e", 3, 0.35, "increasing")]


def test_components_of_chains_and_rings(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)]
    nodes = spark.createDataFrame([(k,) for k in [*range(41), 100, 101, 102, 200]], "id long")
    got = {r.id: r.component for r in pairs.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100} and got[200] == 200


def test_fuzzy_pairs_equal_all_pairs(spark):
    names = ["grand palace", "the grand palace", "grand palce", "wat pho", "wat po", "market"]
    got = {(r.a, r.b) for r in pairs.fuzzy_pairs(spark.createDataFrame([("t", n) for n in names], "g string, n string"), ["g"], "n", 0.75).collect()}

    def score(a, b):
        return indel_ratio(a, b) * (0.7 + 0.3 * min(len(a), len(b)) / max(len(a), len(b)))

    assert got == {(a, b) for a in names for b in names if a < b and score(a, b) >= 0.75}


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_fuzzy_pairs_by_pieces_equal_all_pairs(spark, monkeypatch, threshold):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 24))).strip() or "x" for _ in range(60)]
    names = {x[:i] + y + x[i + d :] for x in base for i, y, d in [(rng.randrange(len(x)), rng.choice(["", "a", "zz"]), rng.randint(0, 2)) for _ in range(6)]} | set(base)
    rows = [(g, n.strip()) for n in names for g in ("t", None) if n.strip()]
    df = spark.createDataFrame(rows, "g string, n string")
    found = lambda: [tuple(r) for r in pairs.fuzzy_pairs(df, ["g"], "n", threshold).collect()]
    got = found()
    crossed = pairs._names_with_a_piece(*(df.select("g", F.col("n").alias(c)) for c in "ab"), ["g"], threshold).count()
    monkeypatch.setattr(pairs, "BY_PIECES", 2)
    assert len(got) == len(set(got)) > 100 and set(got) == set(found())
    assert crossed < len(rows) ** 2 / 20


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = incremental.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, incremental.upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect()))


def test_semantic_chunk_fold():
    assert chunks.fold_chunks([], []) == []
    starts = [40.0 * k for k in range(12)]
    texts = ["x"] * 12
    texts[4] = "By the way, y"
    assert chunks.fold_chunks(starts, texts)[0] == (0, 3)
    assert all(b - a <= 11 for a, b in chunks.fold_chunks(starts, ["x"] * 12))


def test_semantic_chunks_equal_one_fold_of_a_long_video(spark):
    rng = random.Random(8)
    rows = [("v", k, 17.0 * k, "Finally, x" if rng.random() < 0.1 else "y") for k in range(1300)]  # over six hours
    got = chunks.semantic(spark.createDataFrame(rows, "video_id string, segment_index int, start double, text string").repartition(4)).orderBy("chunk").collect()
    want = chunks.fold_chunks([r[2] for r in rows], [r[3] for r in rows])
    assert [(r.chunk, r.first_segment, r.last_segment) for r in got] == [(k, a, b) for k, (a, b) in enumerate(want)]


def test_warnings_and_first_rule(spark):
    df = spark.createDataFrame([(1,), (5,)], "v int")
    got = df.select(filters.warnings({"odd": F.col("v") % 2 == 1, "big": F.col("v") > 3}).alias("w"), filters.first_rule([("big", F.col("v") > 3), ("odd", F.col("v") % 2 == 1)], "ok").alias("r")).collect()
    assert [(r.w, r.r) for r in got] == [(["odd"], "odd"), (["odd", "big"], "big")]


@pytest.mark.parametrize("query", ["semantic_pairs", "flatten_bi", "knn_filtered"])
def test_scans_read_only_what_they_need(spark, small, query):
    from tidemark.plans.catalog import queries

    plan = queries()[query](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "created_at" not in plan


def test_greedy_clusters_and_diversity_equal_plain_loops(spark):
    from tidemark.operators import sequential

    rng = random.Random(5)
    points = [(10 + rng.uniform(0, 0.2), 20 + rng.uniform(0, 0.2)) for _ in range(150)]
    seeds, want = [], []
    for p in points:
        hit = next((k for k, s in enumerate(seeds) if sequential._km(s, p) <= 2.0), None)
        if hit is None:
            seeds.append(p)
            hit = len(seeds) - 1
        want.append(hit)
    assert sequential.greedy(points, 2.0) == want


def test_word_correction_equals_all_pairs(spark):
    from tidemark.operators import sequential

    rng = random.Random(6)
    known = ["gitazisul", "jivonmülpen", "port vuhopankir", *{"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(40)}]
    typed = {"gtazisull", "jyvonmülpehn", "near port vuhopankir", *("".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(150))} - set(known)
    want = {}
    for w in typed:
        score, k = min((-round(sequence_ratio(w, k), 6), k) for k in known)
        if -score >= 0.85:
            want[w] = (k, -score)
    rows = sequential.correct_words(spark.createDataFrame([(w,) for w in typed], "w string"), spark.createDataFrame([(k,) for k in known], "k string"), "w", "k", 0.85)
    assert {r.w: (r.k, r.ratio) for r in rows.collect()} == want and len(want) > 5


def test_word_correction(spark):
    from tidemark.operators import sequential

    typed, known = spark.createDataFrame([("chiangmai",), ("bangkok",), ("zzz",)], "w string"), spark.createDataFrame([("chiang mai",), ("bangkok",)], "k string")
    assert [(r.w, r.k) for r in sequential.correct_words(typed, known, "w", "k", 0.85).collect()] == [("chiangmai", "chiang mai")]


def test_all_locations_are_normalized(spark, small):
    import re
    import unicodedata

    from tidemark.plans.catalog import queries
    from tidemark.session import table

    def plain(x):
        x = unicodedata.normalize("NFKD", re.sub(r"[,.\-]", " ", x.lower()))
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\-']", "", x)).strip()

    given = {r.location for r in table(spark, small, "extracted_entities").where("location is not null").collect()}
    got = {r.location: r.normalized for r in queries()["normalized_locations"](spark, small).collect()}
    assert got == {x: plain(x) for x in given} and any(not x.isascii() for x in given)
