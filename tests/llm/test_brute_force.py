"""The methods against brute force, round trips and held-out rows."""

import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import fusion, history, language, mixing, places, safety, tokens, tries, turns
from tidemark.llm.names import parse, slips_allowed
from tidemark.llm.spelling import grams, plain, sound, within, within_many
from tidemark.llm.tries import trie_join
from tidemark.session import table


def words(n, seed):
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "l"]) for _ in range(rng.randint(2, 5))) for _ in range(n)))


def spoil(word, rng, k):
    for _ in range(k):
        i = rng.randrange(len(word))
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcdefgh") + word[i:], word[:i] + rng.choice("xyz") + word[i + 1 :]])
    return word


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_prefix_filter_join_equals_all_pairs(spark):
    known = words(120, 1)
    rng = random.Random(2)
    typed = [spoil(w, rng, rng.randint(0, 3)) for w in known for _ in range(2)]
    forms = spark.createDataFrame([(w,) for w in typed if w], "form string")
    spellings = spark.createDataFrame([(w, grams(w)) for w in known], "spelling string, grams array<string>")
    for threshold in (0.25, 0.5, 0.8):
        got = {(r.form, r.spelling): round(r.jaccard, 9) for r in places.similar_spellings(forms, spellings, threshold).collect()}
        want = {}
        for a in set(typed):
            for b in known:
                x, y = set(grams(a)), set(grams(b))
                if a and len(x & y) / len(x | y) >= threshold:
                    want[(a, b)] = round(len(x & y) / len(x | y), 9)
        assert got == want


def test_trie_join_equals_all_pairs(spark):
    known = words(150, 3)
    rng = random.Random(4)
    typed = list({spoil(w, rng, rng.randint(0, 4)) for w in known} - {""})
    got = {(r.query, r.known): r.slips for r in trie_join(spark.createDataFrame([(w,) for w in typed], "query string"), spark.createDataFrame([(w,) for w in known], "known string"), 8).collect()}
    want = {(a, b): d for a in typed for b in known if (d := levenshtein(a, b)) <= slips_allowed(len(b))}
    assert got == want
    keep, tries.SPLIT, tries.PORTION = (tries.SPLIT, tries.PORTION), 2, 3  # hot shards split by queries and by strings
    try:
        again = trie_join(spark.createDataFrame([(w,) for w in typed], "query string"), spark.createDataFrame([(w,) for w in known], "known string"), 8)
        assert {(r.query, r.known): r.slips for r in again.collect()} == want
    finally:
        tries.SPLIT, tries.PORTION = keep


def test_memory_of_a_trie_walk_is_bounded(monkeypatch):
    rng = random.Random(8)
    known = sorted({"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(20_000)})
    typed = [spoil(w, rng, 2) for w in rng.sample(known, 400)]
    trie = tries.Tries(np.zeros(len(known), np.int64), known)
    visits = (np.zeros(len(typed), np.int64), tries.code_points(typed), np.array([len(w) for w in typed], np.int32), np.full(len(typed), 3, np.uint8))
    tracemalloc.start()
    want = {(int(v), known[w], int(d)) for some in trie.walk(*visits) for v, w, d in zip(*some, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    monkeypatch.setattr(tries, "STATES", 1000)
    got = [(int(v), known[w], int(d)) for some in trie.walk(*visits) for v, w, d in zip(*some, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    some = rng.sample(range(len(typed)), 20)
    assert {x for x in want if x[0] in some} == {(v, w, levenshtein(typed[v], w)) for v in some for w in known if abs(len(w) - len(typed[v])) <= 3 and levenshtein(typed[v], w) <= 3}


def test_names_kept_by_a_worker_are_bounded():
    for f in (parse, plain, sound):
        assert f.cache_info().maxsize <= 20_000  # four of 200,000 took 230 MB of a worker


def test_bounded_distance_counts_a_transposition_once():
    assert within("abcd", "abdc", 2) == 1 and within("abcd", "wxyz", 2) == 3 and within("", "ab", 3) == 2


def test_ids_equal_the_public_tokenizer_and_decode(spark, small):
    base64, tiktoken = __import__("base64"), pytest.importorskip("tiktoken")
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, small, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> a"), (-4, "aaaa" * 500), (-5, "  \n\t ")], docs.schema)
    got = {r.doc_id: (r.text, r.ids) for r in docs.unionByName(extra).withColumn("ids", tokens.token_ids("text")).collect()}
    assert all(list(ids) == own.encode_ordinary(text or "") for text, ids in got.values())
    machine = tokens.automaton("byte_bpe_50k", tokens.TOKENIZERS)
    assert all(machine.decode(ids).decode() == (text or "") for text, ids in got.values())


def test_mix_equals_a_sequential_queue(spark, small):
    docs, targets = table(spark, small, "documents"), table(spark, small, "source_targets")
    got = [tuple(r) for r in mixing.mix(docs, targets).orderBy("total").select("source", "doc_id", "pass").collect()]
    sized = mixing.sized(docs, targets).collect()
    plan = {r.source: r for r in mixing.plan(mixing.sized(docs, targets), targets).collect()}
    budget = min(r.feasible for r in plan.values() if r.weight)
    queue = []
    for source, rows in defaultdict(list, {s: [r for r in sized if r.source == s] for s in plan}).items():
        used = 0
        for turn in range(1, plan[source].max_repeats + 1):
            for r in sorted(rows, key=lambda r: (r.place, r.doc_id)):
                used += r.tokens
                queue.append((used / plan[source].weight, source, r.doc_id, turn, r.tokens))
    want, total = [], 0
    for finish, source, doc, turn, n in sorted(queue):
        total += n
        if finish > budget or total > budget:
            continue
        want.append((source, doc, turn))
    assert got == want
    uses = Counter((s, d) for s, d, _ in got)
    assert all(n <= plan[s].max_repeats for (s, _), n in uses.items())
    report = {r.source: r for r in mixing.shares(docs, targets).collect()}
    # fair queueing leaves every source within one of its documents of its share of the budget
    largest = {s: max(r.tokens for r in sized if r.source == s) for s in report}
    assert all(abs(r.tokens - r.target_share * budget) <= largest[s] for s, r in report.items())


def test_slots_leave_no_mark_on_a_mix(spark, small):
    docs, targets = table(spark, small, "documents"), table(spark, small, "source_targets")
    got, keep = [], (mixing.SLOT_ROWS, mixing.LEAST_SLOTS)
    try:
        for mixing.SLOT_ROWS, mixing.LEAST_SLOTS in ((3, 1), (10**9, 1)):
            got.append(sorted(map(tuple, mixing.mix(docs, targets, 50_000.0).collect())))
    finally:
        mixing.SLOT_ROWS, mixing.LEAST_SLOTS = keep
    assert got[0] == got[1] and got[0]


def test_turns_equal_one_sweep_per_video(spark, small):
    videos, transcripts = table(spark, small, "videos"), table(spark, small, "transcripts")
    turns.SLOT_S, keep = 30, turns.SLOT_S  # many slots, so that the carry is tested
    try:
        got = sorted(tuple(r) for r in turns.found(videos, transcripts).collect())
    finally:
        turns.SLOT_S = keep
    credits = {r.video_id: tuple(r.speakers) for r in turns.current_videos(videos).collect() if len(r.speakers) > 1}
    once = {(r.video_id, r.segment_index): r for r in transcripts.collect()}
    want = []
    for video, speakers in credits.items():
        now, number, last = None, 0, None
        rows = sorted((r for (v, _), r in once.items() if v == video), key=lambda r: (r.start, r.segment_index))
        for r in rows:
            for said_by, text in turns.cut_segment(r.text, speakers):
                now = said_by or now
                if any(c.isalnum() or ord(c) > 0x900 for c in text):
                    who = now or 1
                    if who != last:
                        number, last = number + 1, who
                        want.append([video, number, who, r.segment_index, r.segment_index])
                    want[-1][4] = r.segment_index
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("(00:02:14.835) >> SAHUZUTO, Nadim: um, fine.", [(2, "fine.")]),
        ("[Eddda] hello (laughter) there", [(1, "hello there")]),
        ("well <v N.S.> yes uh no >> Edda: ok", [(0, "well"), (2, "yes no"), (1, "ok")]),
        ("Note: bring shoes", [(0, "Note: bring shoes")]),
        ("[Music]", []),
        ("GUIDE - [Music]", [(1, "")]),
        (None, []),
    ],
)
def test_labels(text, pieces):
    assert turns.cut_segment(text, ("Edda Ledeminet (guide)", "Nadim Sahuzuto (producer)")) == pieces


def test_repetition_of_rolling_captions_is_cut():
    assert turns.trim_repeat("we went up the hill", "The hill was green") == "was green"
    assert turns.trim_repeat(None, "a b") == "a b"


def test_repetition_is_cut_without_overlap_in_time(spark):
    videos = spark.createDataFrame([("v", ["Edda Ledeminet"], None)], "video_id string, speakers array<string>, fetched_at timestamp")
    said = [
        (0, 0.49, 4.56, "this is how they fold the hirune"), (1, 7.56, None, "fold the hirune To be fair"), (2, 9.0, 0.0, "To be fair"),
        (3, 10.0, 1.0, "fair enough"), (4, None, 1.0, "so we went on"), (5, None, 1.0, "So we went on then"),
    ]
    rows = spark.createDataFrame([("v", *r) for r in said], "video_id string, segment_index int, start double, duration double, text string")
    got = turns.turns(videos, rows).orderBy("turn_no", "part_no").collect()
    assert " ".join(r.text for r in got) == "this is how they fold the hirune To be fair fair enough so we went on then"


def test_slots_leave_no_mark_on_turns(spark, small):
    videos, transcripts = table(spark, small, "videos"), table(spark, small, "transcripts")
    got, keep = [], (turns.SLOT_S, turns.SLOT_SEGMENTS)
    try:
        for turns.SLOT_S, turns.SLOT_SEGMENTS in ((30, 3), (10**8, 10**8)):
            got.append(sorted(map(tuple, turns.turns(videos, transcripts).collect()), key=str))
    finally:
        turns.SLOT_S, turns.SLOT_SEGMENTS = keep
    assert got[0] == got[1] and got[0]


def test_language_of_held_out_documents(spark, small):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null and lang is not null").collect()
    train = [(r.lang, r.text, 1.0) for r in docs if r.doc_id % 3]
    model = language.fit(train)
    assert "nl" not in model.languages and {"en", "es", "de"} <= set(model.languages)
    hits = total = 0
    for r in docs:
        if r.doc_id % 3 == 0 and r.lang in model.languages:
            said = language.spoken_words(r.text)
            if len(said) >= 8:
                total += 1
                hits += model.languages[model.nearest(said)[0]] == r.lang
    assert hits / total > 0.9  # some labels are wrong
    assert language.code_of("en_GB") == "en" and language.code_of("Deutsch") == "de" and language.code_of("und") is None


def test_segments_of_one_language_are_compared_together(spark, small, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null and lang is not null").collect()
    model = language.fit([(r.lang, r.text, 1.0) for r in docs])
    rng = random.Random(5)
    texts = [language.spoken_words(r.text) for r in docs]
    pieces = [t[k : k + rng.randint(1, 30)] for t in texts for k in range(0, len(t), 30)]
    mixed = [rng.choice(pieces) + rng.choice(pieces) for _ in range(300)]
    odd = [[], ["qqqq"], ["\u0001xxyzzy", *texts[0][:4]], ["7"], max(texts, key=len) * 9, texts[1][:1]]
    every = [p[:] for p in pieces + mixed + odd for _ in range(2)]
    rng.shuffle(every)
    alone = [model._runs(w) for w in every]
    again, calls = language.fit([(r.lang, r.text, 1.0) for r in docs]), []
    plain_runs = language.Centroids._runs
    monkeypatch.setattr(language.Centroids, "_runs", lambda self, w: calls.append(w) or plain_runs(self, w))
    monkeypatch.setattr(language, "AT_ONCE", 500, raising=False)
    monkeypatch.setattr(language, "KEPT_WORDS", 800, raising=False)  # words are forgotten on the way
    monkeypatch.setattr(language, "cut_segment", lambda text, _: [(0, text)])
    monkeypatch.setattr(language, "spoken_words", str.split)
    batch = pa.RecordBatch.from_pydict({"v": ["v"] * len(every), "s": pa.array(range(len(every)), pa.int32()), "t": [" ".join(w) for w in every], "c": [""] * len(every)})
    got = next(language._detect(SimpleNamespace(value=again), True)(iter([batch]))).to_pydict()
    want = [(k, model.languages[b], len(w), round(min(1.0, 0.5 + lead), 4), " ".join(w).replace("\u0001", "")) for k, runs in enumerate(alone) for b, w, cosine, lead in runs if cosine >= language.MIN_COSINE]
    assert list(zip(*(got[c] for c in ("segment_index", "lang", "words", "confidence", "text")), strict=True)) == want and len(want) > 500
    changes = {" ".join(w) for w, runs in zip(every, alone, strict=True) if len(runs) > 1 or len(w) > 64}
    assert changes and len(calls) < 3 * len(changes) and len(calls) < len({" ".join(w) for w in every}) / 2


def test_severity_separates_disguised_insults():
    said = [("You are a stupid idiot and nobody wants you here", "abusive"), ("The soup was great", "none"), ("We walked to the bridge", "none"), ("Send me nudes I am so horny", "sexual")] * 3
    model = safety.fit([(t + f" {'x' * k}", Counter([c])) for k, (t, c) in enumerate(said)])
    worst = lambda t: [v for v, _ in model.worst(t)]
    assert worst("You are a stupid i d i o t")[0] >= safety.CASE
    assert worst("you are an ａｓｓｈｏｌｅ, kill yourself")[0] >= safety.CASE
    assert max(worst("That hill climb will kill your legs")) < safety.CASE and worst(None) == [0.0] * 3
    assert safety.canonical("vermmmin") == safety.canonical("VERMIN") and safety.canonical("sсumbag") == safety.canonical("scumbag")


def test_fusion_prefers_right_forms_and_discounts_copies(spark):
    rows = [
        (1, 1, "r1", "Bose Museum", None, 10.1, 20.1, 1), (2, 1, "r2", "BOSE MUSEUM", ["Bose Museum"], -10.1, 20.1, 2), (3, 1, "r3", "Bose Museum", None, 10.1, 20.1, 3),
        (4, 2, "r1", "Old Name Hotel", None, None, None, 1), (5, 2, "r2", "New Lodge Hotel", ["Zaro Pimi Hotel"], 10.0, 20.0, 5), (6, 2, "r3", "Zaro Pimi Hotel", None, 99.0, 20.0, 1),
    ]
    from datetime import datetime

    full = [Row(record_id=a, group_id=g, run_id=r, canonical_name=n, aliases=al, entity_type="hotel", city="Town", country="Land", latitude=la, longitude=lo, geocoding_source="llm", total_mentions=1, updated_at=datetime(2025, 1, t)) for a, g, r, n, al, la, lo, t in rows]  # noqa: E501
    schema = "record_id long, group_id long, run_id string, canonical_name string, aliases array<string>, entity_type string, city string, country string, latitude double, longitude double, geocoding_source string, total_mentions int, updated_at timestamp"
    spots = spark.createDataFrame([(1, "city", "Town", "Land", "LA", None, 10.0, 20.0)], "place_id long, kind string, city string, country string, country_code string, alt_names array<string>, latitude double, longitude double")
    got = {r.group_id: r for r in fusion.found(spark.createDataFrame(full, schema), spots).collect()}
    assert (got[1].name_record, got[1].latitude_record) == (1, 1)
    assert (got[2].name_record, got[2].latitude_record) == (5, 0)  # former name out, centre of the city is not its own place


@pytest.mark.parametrize("city", [5, 0])
@pytest.mark.parametrize(("length", "slips"), [(5, 1), (6, 1), (7, 1), (7, 2), (8, 2), (9, 2), (10, 2), (10, 3), (12, 3)])
def test_bands_meet_nine_of_ten_spellings_within_the_slips(city, length, slips):
    rng = random.Random(length + slips)
    hits = total = 0
    while total < 200:
        known = "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") + rng.choice(["", "n", "r", "l"]) for _ in range(6))[:length]
        typed = spoil(known, rng, slips)
        if len(typed) < 3 or within(typed, known, slips) != slips or slips_allowed(len(known)) < slips:
            continue
        total += 1
        a, b = history.signatures([typed, known])
        met = bool(set(history.band_keys(a, city, probe=True)) & set(history.band_keys(b, city)))
        hits += met and int(((a ^ b) & np.uint64(1)).sum()) <= history.BITS_APART
    assert hits / total >= 0.9


def test_bands_meet_across_a_missing_city():
    (sign,) = history.signatures(["karinomeb"])
    for a, b in ((0, 5), (5, 0), (0, 0), (5, 5)):
        assert set(history.band_keys(sign, a, probe=True)) & set(history.band_keys(sign, b))
    assert not set(history.band_keys(sign, 4, probe=True)) & set(history.band_keys(sign, 5))


@pytest.mark.parametrize("slips", [0, 1, 2])
def test_texts_within_the_slips_spared_share_a_key(slips):
    rng = random.Random(slips)
    pairs = []
    while len(pairs) < 3000:
        known = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 18)))
        typed = list(spoil(known, rng, rng.randint(0, min(slips, len(known) - 1))))
        if slips and len(typed) > 1 and rng.random() < 0.5:
            i = rng.randrange(len(typed) - 1)
            typed[i : i + 2] = typed[i + 1], typed[i]
        if typed and within("".join(typed), known, slips) <= slips:
            pairs.append(("".join(typed), known))
    typed, known = (history.spared_keys(list(side), slips) for side in zip(*pairs, strict=True))
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(typed, known, strict=True))


def meetings(spark, typed, known):
    """Meetings of typed and known texts (text, city_id, kind) in a key, and the pairs of texts that met."""
    as_rows = lambda rows, probe: history.entries(spark.createDataFrame(rows, "text string, city_id long, kind string"), probe)
    met = as_rows(typed, True).join(as_rows(known, False).select("key", F.col("text").alias("k_text")), "key").select("text", "k_text").collect()
    return len(met), {tuple(r) for r in met}


@pytest.mark.parametrize(("city", "most"), [(5, 0.05), (0, 0.01)])  # three slips count in one city and kind, a sixth of these pairs
def test_names_of_no_relation_hardly_meet(spark, city, most):
    names = [w for w in words(900, 21) if len(w) >= 8]
    first, second = names[::2], names[1::2]
    kinds = ["hotel", "museum", "", "cafe", "palace"]
    typed, known = ([(w, city, kinds[k % 5]) for k, w in enumerate(side)] for side in (first, second))
    count, _ = meetings(spark, typed, known)
    assert count <= most * len(first) * len(second)


def test_three_slips_meet_in_one_city_and_kind_and_two_anywhere(spark):
    rng, known, far, near = random.Random(22), [], [], []
    for w in (w for w in words(1500, 23) if len(w) >= 10):
        three, two = spoil(w, rng, 3), spoil(w, rng, 2)
        if within(three, w, 3) == 3 and within(two, w, 2) == 2:
            known.append((w, 5, "hotel"))
            far.append((three, 5, "hotel"))
            near.append((two, 0, ""))
    _, met = meetings(spark, far, known)
    assert sum((a[0], b[0]) in met for a, b in zip(far, known, strict=True)) >= 0.93 * len(known)
    _, met = meetings(spark, near, known)
    assert all((a[0], b[0]) in met for a, b in zip(near, known, strict=True)) and len(known) > 200


def test_batches_at_once_equal_batch_by_batch_on_one_index(spark, small, tmp_path):
    intake, canonical, spots = (table(spark, small, t) for t in ("entity_intake", "canonical_entities", "places"))
    every = table(spark, "/root/testdata/sf0.01", "entity_intake").where("batch_no <= 3")
    at_once = {tuple(r) for r in history.deduplicate(every, canonical, spots).collect()}
    where, by_batch = f"file://{tmp_path}/index", set()
    for batch in (1, 2, 3):
        by_batch |= {tuple(r) for r in history.deduplicate(every.where(f"batch_no = {batch}"), canonical if batch < 3 else None, spots, where).collect()}
    assert at_once == by_batch and any(k is not None for _, _, k in at_once)
    index = history.History(spark, where)
    facts = index.facts()
    assert facts.count() == facts.distinct().count()  # a filled folder isn't filled again
    new = {i for i, _, k in at_once if k is None}
    assert {r.record for r in facts.select("record").distinct().collect()} <= new | {r.entity_no for r in canonical.collect()}


def test_index_is_laid_out_anew_when_it_has_grown(spark, tmp_path):
    keep, history.PART_TEXTS, history.GROWTH = (history.PART_TEXTS, history.GROWTH), 1, 2
    try:
        index = history.History(spark, f"file://{tmp_path}/grown")
        for k in range(3):
            rows = [(1000 * k + i, "full", f"{w}{k}", "", 0, 5, 1, False, "hotel") for i, w in enumerate(words(90, k))]
            index.append(spark.createDataFrame(rows, history.History.FACTS))
        again = history.History(spark, f"file://{tmp_path}/grown")
        assert again.parts > 200 and again.facts().count() == again.texts
        probe = history.entries(spark.createDataFrame([(rows[7][2], 5)], "text string, city_id long"), probe=True)
        assert rows[7][2] in {r.k_text for r in history.near_texts(probe, again.met(probe)).collect()}
    finally:
        history.PART_TEXTS, history.GROWTH = keep


def test_chain_of_near_names_in_a_batch_ends_at_its_first(spark, small):
    letters = "bakodimunerasolitevu"
    names = [f"{letters[k * 1 : k + 10]} Museum" for k in range(0, 10)]  # each a letter off at either end from the one before
    rows = [(100 + k, 1, None, None, n, "museum", None, None, None, None, 1.0) for k, n in enumerate(names)]
    intake = spark.createDataFrame(rows, table(spark, small, "entity_intake").schema)
    got = {r.intake_id: r.known_id for r in history.deduplicate(intake, table(spark, small, "canonical_entities").limit(0), table(spark, small, "places")).collect()}
    assert got[100] is None and all(got[100 + k] == 100 for k in range(1, 10))
    assert history.History  # one call, ten links


def test_repetitions_are_settled_in_order_of_batch(spark):
    # 11 repeats 1; 12 knows only 11, which isn't in the index, so it is new; 13 knows 12
    pairs = [(11, 2, 1, 1, 0), (12, 3, 11, 2, 0), (13, 4, 12, 3, 0), (14, 4, 13, 4, 1), (15, 4, 12, 3, 2), (15, 4, 14, 4, 0)]
    got = dict(map(tuple, history.verdicts(spark.createDataFrame(pairs, "record long, batch_no int, known long, k_batch_no int, cost int")).collect()))
    assert got == {11: 1, 13: 12, 14: 12, 15: 12}


def test_distances_of_many_pairs_equal_those_of_one():
    rng = random.Random(11)
    a = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    b = [x[: len(x) // 2] + x[len(x) // 2 + 1 :] if rng.random() < 0.5 else rng.choice(a) for x in a]
    k = np.array([rng.randint(0, 4) for _ in a])
    assert within_many(a, b, k).tolist() == [within(x, y, int(z)) for x, y, z in zip(a, b, k, strict=True)]


def test_long_chains_of_a_batch_end_at_their_first_record(spark):
    rows = [(k, 7 if k == 100 else None, None if k in (100, 200) else k - 1) for first in (100, 200) for k in range(first, first + 40)]
    got = {r.record: (r.known, r.near) for r in history.settled(spark.createDataFrame(rows, "record long, known long, near long")).collect()}
    assert all(got[k] == (7, None) for k in range(100, 140)) and all(got[k] == (None, 200) for k in range(201, 240)) and got[200] == (None, None)


def test_batches_agree_with_all_pairs_on_exact_repeats(spark, small):
    intake, canonical, spots = (table(spark, small, t) for t in ("entity_intake", "canonical_entities", "places"))
    got = {r.new_id: r.known_id for r in history.found(intake, canonical, spots).collect()}
    rows = sorted((r for r in intake.collect() if r.city and parse(r.entity_name).core and parse(r.entity_name).kind), key=lambda r: r.intake_id)
    seen = {}
    for r in rows:
        key = (sound("".join(parse(r.entity_name).core)), parse(r.entity_name).kind, r.city)
        if key in seen:
            assert r.intake_id in got and got[r.intake_id] <= seen[key]
        seen.setdefault(key, r.intake_id)
    assert all(k < n for n, k in got.items()) and not set(got.values()) & set(got)


def planted_claims():
    """60 items: three honest sources that err on their own, and a liar whose values three others copy."""
    rng, rows, truth = random.Random(5), [], {}
    for g in range(60):
        truth[g] = f"t{g}"
        said = {s: truth[g] if rng.random() < 0.9 else f"{s}{rng.randint(0, 19)}" for s in "ABC"}
        lie = truth[g] if rng.random() < 0.4 else f"lie{g}"
        said |= dict.fromkeys("LMNO", lie)
        rows += [("f", g, 10 * g + k, s, v, 1.0, 0.0) for k, (s, v) in enumerate(said.items())]
    return rows, truth


def test_fusion_finds_copiers_where_plain_counts_follow_them(spark):
    rows, truth = planted_claims()
    claims = spark.createDataFrame(rows, "field string, group_id long, record_id long, source string, value string, weight double, prior double")
    got = {r.group_id: r.value for r in fusion.fuse(claims).where("best").collect()}
    counted = {g: Counter(r[4] for r in rows if r[1] == g).most_common(1)[0][0] for g in truth}
    right = lambda said: sum(said.get(g) == t for g, t in truth.items()) / len(truth)
    assert right(counted) < 0.6 and right(got) > 0.9


@pytest.mark.parametrize("chunk", [2, 256])
def test_sources_beyond_the_matrices_have_accuracies_and_copiers_of_their_own(spark, monkeypatch, chunk):
    rows, truth = planted_claims()
    claims = spark.createDataFrame(rows, "field string, group_id long, record_id long, source string, value string, weight double, prior double")
    want = {(r.group_id, r.value): (r.records, round(r.posterior, 5), r.best) for r in fusion.fuse(claims).collect()}
    monkeypatch.setattr(fusion, "MAX_SOURCES", 3)
    monkeypatch.setattr(fusion, "PAIR_CHUNK", chunk)
    got = {(r.group_id, r.value): (r.records, round(r.posterior, 5), r.best) for r in fusion.fuse(claims).collect()}
    assert got == want
    assert sum(truth[g] == v for (g, v), (_, _, best) in got.items() if best) / len(truth) > 0.9


def test_sources_that_differ_are_independent():
    accuracy = np.full(2, 0.7)
    together = lambda false, true, both: np.array([[[0, n], [n, 0]] for n in (false, true, both)], float)
    assert fusion.dependence(together(3, 40, 100), accuracy)[0, 1] < 0.01  # chance hits among many items
    assert fusion.dependence(together(30, 40, 80), accuracy)[0, 1] > 0.99
    assert fusion.dependence(together(0, 0, 0), accuracy)[0, 1] == 0.0


def test_nothing_is_chosen_where_only_doubtful_values_are_claimed(spark):
    rows = [("f", 1, k, f"s{k}", "BAD_", fusion.DOUBTFUL, fusion.DOUBT) for k in range(6)] + [("f", 2, 9, "s1", "Good", 1.0, 0.0)]
    claims = spark.createDataFrame(rows, "field string, group_id long, record_id long, source string, value string, weight double, prior double")
    assert [(r.group_id, r.value) for r in fusion.fuse(claims).where("best").collect()] == [(2, "Good")]
