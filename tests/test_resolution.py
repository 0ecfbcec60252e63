"""Retrieval, merging and tiered resolution against small brute-force versions and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import merging, pairs, resolution, retrieval


def indel_ratio(a, b):
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


def entity_similarity(a, b):
    sort = lambda s: " ".join(sorted(s.split()))
    (n, p), (m, q) = a, b
    name = max(indel_ratio(sort(n), sort(m)), 0.85 if n in m or m in n else 0)
    place = 1.0 if not p and not q else 0.8 if not p or not q else max(indel_ratio(sort(p), sort(q)), 0.9 if p in q or q in p else 0)
    return 0.7 * name + 0.3 * place


def test_matches_in_a_video_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["big", "buddha", "temple", "beach", "patong", "patng", "market", "night", "of"]
    rows = [(f"v{rng.randint(0, 2)}", rng.choice(["destination", "attraction", "restaurant", "shopping", "hotel", None]), " ".join(rng.sample(words, rng.randint(1, 3))), rng.choice([None, "", "Town", "Old Town", "Pier"])) for _ in range(90)]
    rows += [("v1", "hotel", None, None), (None, "hotel", "big", None), ("v1", "hotel", "  ", "x")]
    got = {(r.v, r.a, r.a_place, r.b, r.b_place): r.score for r in resolution.in_group_matches(spark.createDataFrame(rows, "v string, k string, n string, p string"), "v", "k", "n", "p").collect()}
    low = lambda s: (s or "").strip().lower()
    kind = lambda k: resolution.COMPATIBLE.get(k, k or "")
    once = {(v, kind(k), low(n), low(p)) for v, k, n, p in rows if v and low(n)}
    want = {}
    for v, k, n, p in once:
        for w, l, m, q in once:
            if (v, k) == (w, l) and (n, p) < (m, q) and (s := entity_similarity((n, p), (m, q))) >= 0.75 - 5e-7:
                want[(v, n, p, m, q)] = round(s, 6)
    assert {k: pytest.approx(s, abs=2e-6) for k, s in want.items()} == got and got


def test_chunks_of_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 5))
    rows = [(k, int(k % 3) if k else None, v.tolist()) for k, v in enumerate(vectors)] + [(100, 1, [0.0] * 5), (101, 1, None), (102, 1, []), (103, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = {(a, b) for a in range(1, 60) for b in range(a + 1, 60) if a % 3 == b % 3 and unit[a] @ unit[b] >= 0.5}
    for chunk in (1000, 4):
        got = [(r.a, r.b) for r in pairs.semantic(df, "g", "id", "v", 0.5, chunk).collect()]
        assert set(got) == want and len(got) == len(want)


def test_entity_tiers_see_only_what_is_unmatched(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "hotel", "Grand Palace Inn", x), (2, "hotel", "grand palace inn ", y), (3, "hotel", "Grand Palace In", y), (4, "hotel", "Grand Place Inns", None), (5, "hotel", "Zebra", x), (6, "hotel", None, x), (7, "cafe", "Zebra", x)]
    df = spark.createDataFrame(rows, "id long, t string, n string, v array<double>")
    yes = lambda p: p.select("a", "b", "score", F.lit(True).alias("verdict"), F.when(F.col("b") == 6, 0.5).otherwise(0.8).alias("confidence"))
    got = {(r.a, r.b): (r.tier, r.method) for r in resolution.entity_tiers(df, "id", ["t"], "n", "v", yes).collect()}
    assert got[(1, 2)] == (1, "exact") and got[(1, 3)][0] == 2 and got[(1, 5)] == (4, "meaning verified")
    assert (1, 6) not in got and all(7 not in k for k in got) and len({b for _, b in got}) == len(got)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    ids = lambda w: {r.x for r in df.where(retrieval.predicate(w)).collect()}
    assert ids({}) == {1, 2, 3} and ids({"x": 2}) == {2} and ids({"x": {"$gte": 2, "$lt": 3}, "y": {"$ne": "a"}}) == {2}
    assert ids({"$or": [{"x": 1}, {"y": {"$in": ["b"]}}]}) == {1, 2} and ids({"$and": []}) == {1, 2, 3} and ids({"y": {"$nin": ["a"]}}) == {2}
    with pytest.raises(ValueError, match="unknown operator"):
        retrieval.predicate({"x": {"$near": 1}})


def test_retrieval_falls_back_only_when_short(spark):
    rows = [(k, f"t{k % 2}", k / 10) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, t string, s double")
    plan = lambda pool, spare: {r.id for r in retrieval.retrieval_plan(pool, spare, "id", "t", "s", 8, F.lit(True), F.lit(0.0), F.col("s")).collect()}
    assert plan(df.where("id <= 6"), df.where("id > 6")) == {1, 2, 3, 4, 5, 6}
    assert plan(df.where("id <= 3"), df) == {1, 2, 3, 4, 5, 6, 7, 8} and plan(df.limit(0), df.limit(0)) == set()


def test_stage_states_replay(spark):
    rows = [("k", 1, "start", 0), ("k", 1, "fail", 1), ("k", 1, "start", 2), ("k", 1, "complete", 9), ("k", 2, "fail", 0), ("k", 2, "reset", 1), ("j", 2, "register", 0), ("k", 3, "noise", 1)]
    df = spark.createDataFrame([(k, s, o, t, i) for i, (k, s, o, t) in enumerate(rows)], "k string, stage int, op string, t int, i int").withColumn("t", F.timestamp_seconds("t"))
    states = merging.stage_states(df, "k", "stage", "op", "t", "i")
    assert sorted(map(tuple, states.collect())) == [("j", 2, "pending", 0, 0), ("k", 1, "complete", 2, 7), ("k", 2, "pending", 0, 0)]
    assert [(r.k, r.stage) for r in merging.pending_stages(states, "k", "stage").collect()] == [("k", 2)]


def test_merge_rules_on_missing_values(spark):
    df = spark.createDataFrame([(None, None, None), (["B", None, "a"], ["A", "c"], "b")], "o array<string>, n array<string>, name string")
    got = df.select(merging.union_sorted(F.col("o"), F.col("n")), merging.union_ordered(F.col("o"), F.col("n"), 2), merging.merge_aliases(F.col("o"), F.col("n"), F.col("name"))).collect()
    assert [tuple(r) for r in got] == [([], [], []), (["A", "B", "a", "c"], ["B", "a"], ["A", "a", "c"])]
