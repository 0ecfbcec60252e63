"""Every operator on empty tables, null rows, repeated rows, very long texts and tables with extra, clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fusion, history, language, mixing, places, safety, tokens, turns, variants
from tidemark.session import table

TABLES = ["extracted_entities", "places", "videos", "transcripts", "documents", "canonical_snapshots", "entity_intake", "canonical_entities", "source_targets", "review_labels"]
OPERATORS = {
    "p1": lambda t: places.found(t["extracted_entities"], t["places"]),
    "p1_unmatched": lambda t: places.unmatched(t["extracted_entities"], t["places"]),
    "p2": lambda t: language.found(t["videos"], t["transcripts"], t["documents"]),
    "p3": lambda t: fusion.found(t["canonical_snapshots"], t["places"]),
    "p3_survivors": lambda t: fusion.survivors(t["canonical_snapshots"], t["places"]),
    "p4": lambda t: history.found(t["entity_intake"], t["canonical_entities"], t["places"]),
    "p5": lambda t: variants.found(t["extracted_entities"], t["canonical_entities"], t["places"]),
    "p6": lambda t: turns.found(t["videos"], t["transcripts"]),
    "p6_turns": lambda t: turns.turns(t["videos"], t["transcripts"]),
    "p7": lambda t: tokens.encode_documents(t["documents"]),
    "p8": lambda t: mixing.mix(t["documents"], t["source_targets"]),
    "p8_shares": lambda t: mixing.shares(t["documents"], t["source_targets"]),
    "p9": lambda t: safety.found(t["documents"], t["review_labels"]),
    "p9_rates": lambda t: safety.rates(t["documents"], t["review_labels"]),
}
CLASHES = ["key", "triple", "form", "slot", "record", "value", "rank", "kind", "part", "n", "query", "known", "slips", "pass", "tokens", "at", "first", "lang_", "piece", "seen"]


@pytest.fixture(scope="module")
def plain(spark, small):
    return {name: table(spark, small, name) for name in TABLES}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(plain, name):
    out = OPERATORS[name]({k: df.limit(0) for k, df in plain.items()})
    assert out.count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_rows_long_texts_and_extra_columns(spark, plain, name):
    odd = {}
    for k, df in plain.items():
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        texts = [c for c, t in df.dtypes if t == "string" and not c.endswith("_id") and c not in ("lang", "kind", "source", "category", "run_id")]
        long = df.limit(1).withColumns({c: F.repeat(F.concat(F.coalesce(c, F.lit("x")), F.lit(" word")), 3000) for c in texts})
        odd[k] = df.limit(40).unionByName(nulls).unionByName(nulls).unionByName(long)
        odd[k] = odd[k].withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})
    if name == "p7":
        odd["documents"] = odd["documents"].where("doc_id is not null")
    OPERATORS[name](odd).collect()


@pytest.mark.parametrize("name", ["p1", "p2", "p3", "p4", "p5", "p6", "p9"])
def test_repeated_rows_change_nothing(plain, name):
    once = OPERATORS[name](plain)
    twice = OPERATORS[name]({k: df.unionByName(df) if k not in ("places", "review_labels") else df for k, df in plain.items()})
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == rows(twice)
