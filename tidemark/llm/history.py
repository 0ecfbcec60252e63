"""Problem 4: new batches deduplicated against all history, without reprocessing the history.

Method: persisted minwise band keys. Every text that an accepted record is known by is hashed once to keys, which are kept
with the text's minwise signature in an index partitioned by hash of the key. New rows compute their own keys, read only
the parts of the index that hold one of them, and meet the entries of equal keys; a pair is verified by its signatures
first, then by edit distance, kind and place; the records accepted as new are appended. Rows of one batch also meet each
other; chains among them end at their first record.

The keys are as narrow as the rule that accepts a pair, so that texts of no relation hardly meet: three slips count only
within one city and kind, so the minwise bands hold both; pairs of up to two slips, whatever their cities and kinds, meet
in what is left of the two texts without as many letters, which misses none; forms meet only forms they may stand for.

One call takes any number of batches: all are probed at once, and their verdicts are settled in order of batch, as if
each batch had been offered by itself. A call to a folder that holds an index goes on from there.

Defined results: null, blank and generic names are never repetitions and never become history; another city, or another
kind, is another entity; a missing city decides nothing, the nearest name wins, then the smaller id; rows with a null
batch_no come last; repeated intake_ids count once; empty tables give no rows. Rows of equal values are looked up once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.names import slips_allowed
from tidemark.llm.spelling import grams, within_many
from tidemark.llm.variants import entities_of, known_forms, listed_city, typed_forms, with_place
from tidemark.session import cut_lineage, materialize, scratch_path

#: Bands and rows of the keys within one city, and of those without a city.
CITY_BANDS, CITY_ROWS = 32, 2
FREE_BANDS, FREE_ROWS = 24, 2
#: Letters at the end of a text (many begin with the same first name) of which up to SPARED are spared in the keys of pairs
#: of up to SPARED slips.
TAIL, SPARED = 11, 2
#: Minwise hashes of a signature, of each of which the index keeps one bit (so half of the bits of two texts that share
#: nothing agree), and the bits that may differ: an estimate of 0.06 shared letter pairs, where spellings have 0.3 or more.
HASHES, BITS_APART = 128, 60
#: Texts of one part of the index when it is laid out; it is laid out anew when the parts are GROWTH times as large.
PART_TEXTS, GROWTH = 2_000, 8

_RNG = np.random.default_rng(1234)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_POWERS = _RNG.integers(1, 1 << 63, TAIL + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, the same on every machine and in every run."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=50_000)
def _gram(gram: str) -> int:
    return int(_mixed(np.array([zlib.crc32(gram.encode()) + 1], np.uint64))[0])


def signatures(texts: list[str]) -> np.ndarray:
    """Minwise hashes of the letter pairs of texts that aren't empty: a row each."""
    parts = [[_gram(g) for g in grams(t)] for t in texts]
    hashes = np.array([h for p in parts for h in p], np.uint64)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
    mixed = (hashes[:, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)
    return np.minimum.reduceat(mixed, starts, axis=0)


def band_keys(sign: np.ndarray, city: int, probe: bool = False) -> np.ndarray:
    """Keys of a signature: bands with the city (if it has one), and bands without, named by whether it has one.

    A pair of two cities meets in its city or not at all, so a `probe` with a city seeks only texts without one, and a
    probe without a city seeks both.
    """

    def keys(bands: int, rows: int, salt: int) -> np.ndarray:
        out = np.arange(bands, dtype=np.uint64) + np.uint64(salt << 8)
        for r in range(rows):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ sign[r : bands * rows : rows])
        return out

    out = [keys(CITY_BANDS, CITY_ROWS, city * 4 + 2)] if city else []
    for has_city in ((False,) if city else (False, True)) if probe else (bool(city),):
        out.append(keys(FREE_BANDS, FREE_ROWS, int(has_city)))
    return np.concatenate(out).astype(np.int64)


@lru_cache(maxsize=50_000)
def _salt(name: str) -> np.uint64:
    return _mixed(np.array([zlib.crc32(name.encode()) + (1 << 40)], np.uint64))[0]


@lru_cache(maxsize=64)
def _left(size: int, spared: int) -> np.ndarray:
    """The places of `size` letters that are left when `spared` are dropped: a row for each choice."""
    rows = [[i for i in range(size) if i not in out] for out in combinations(range(size), spared)]
    return np.array(rows, np.int64).reshape(len(rows), size - spared)


def spared_keys(texts: list[str], spared: int) -> list[np.ndarray]:
    """Hashes of what is left of the last TAIL letters of each text without 0 to `spared` of them.

    Two texts within k edits, a swap of neighbours being one, have k letters each at most beyond what they share in order.
    So have their tails: where d letters of one tail stand before the tail of the other, that other holds d letters more
    of its own. So texts within `spared` edits have a hash in common, whatever the edits.
    """
    tails, out = [t[-TAIL:] for t in texts], [np.zeros(0, np.uint64)] * len(texts)
    sizes = np.array([len(t) for t in tails], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        codes = np.array([[ord(c) for c in tails[i]] for i in at], np.uint64).reshape(len(at), int(size))
        made = []
        for drop in range(min(spared, int(size)) + 1):
            left = _left(int(size), drop)
            made.append(_mixed((codes[:, left] * _POWERS[: left.shape[1]]).sum(axis=2, dtype=np.uint64) + _POWERS[-1:] * np.uint64(left.shape[1])))
        for i, row in zip(at, np.concatenate(made, axis=1), strict=True):
            out[i] = row
    return out


def _sought(form: str, text: str, turn: int, probe: bool) -> list[tuple[str, int]]:
    """(class of keys, letters spared) of a text in a form: as the forms in _verified() may stand for each other."""
    most = min(slips_allowed(len(text) + SPARED if probe else len(text)), SPARED)
    if form != "full":
        if form != "short":
            return [(form, most)]
        return [("exact", 0)] * (turn <= 1) if probe else [("short", 1)]
    return [("full", most), ("short", int(len(text) >= 7))] if probe else [("full", most)]


def text_keys(text: str, city: int, uses: list[tuple[str, str, int]], sign: np.ndarray, spared: list[np.ndarray], probe: bool) -> np.ndarray:
    """All keys of a text with its `uses` (form, kind, turn), its signature, and spared_keys() for each number of letters."""
    classes, out = set(), []
    for form, kind, turn in uses:
        classes.update(_sought(form, text, turn, probe))
        if form == "full" and not kind and not probe:
            classes.add(("exact", 0))
    for name, most in classes:
        out.append(_mixed(spared[most] ^ _salt(name)))
    # a third slip counts in one city and kind only, and in a known text of ten letters or more
    if city and len(text) >= (7 if probe else 10):
        for kind in {kind for form, kind, _ in uses if form == "full" and kind}:
            out.append(_mixed(band_keys(sign, city, probe)[:CITY_BANDS].view(np.uint64) ^ _salt("kind " + kind)))
    return np.unique(np.concatenate(out).view(np.int64)) if out else np.zeros(0, np.int64)


def _entries(probe: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                some = pdf.iloc[at : at + 2000]
                texts = some["text"].tolist()
                signs = signatures(texts)
                bits = (signs & np.uint64(1)).reshape(len(some), 2, 64)
                packed = (bits * _WEIGHTS).sum(axis=2, dtype=np.uint64).astype(np.int64)
                spared = zip(*[spared_keys(texts, k) for k in range(SPARED + 1)], strict=True)
                keys = [
                    text_keys(t, int(c), [(u["form"], u["kind"], u["turn"]) for u in uses], s, list(left), probe)
                    for t, c, uses, s, left in zip(texts, some["city_id"], some["uses"], signs, spared, strict=True)
                ]
                yield pd.DataFrame({"text": some["text"], "city_id": some["city_id"], "sign_a": packed[:, 0], "sign_b": packed[:, 1], "keys": keys})

    return run


def entries(texts: DataFrame, probe: bool = False) -> DataFrame:
    """Keys and signatures of distinct texts: key, text, city_id, sign_a, sign_b.

    `texts` has text and city_id, and may have form, kind and turn; without them each text is a full one of no kind.
    """
    use = [F.col(c) if c in texts.columns else F.lit(v).alias(c) for c, v in (("form", "full"), ("kind", ""), ("turn", 0))]
    made = texts.where("text <> ''").groupBy("text", "city_id").agg(F.collect_set(F.struct(*use)).alias("uses")).mapInPandas(
        _entries(probe), "text string, city_id long, sign_a long, sign_b long, keys array<long>"
    )
    return made.select(F.explode("keys").alias("key"), "text", "city_id", "sign_a", "sign_b")


@F.pandas_udf(T.IntegerType())
def _slips(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series(within_many(a.tolist(), b.tolist(), most.to_numpy()))


def _most_slips(text: str) -> Column:
    """slips_allowed() of the length of a column."""
    size = F.length(text)
    return F.when(size <= 4, slips_allowed(4)).when(size <= 6, slips_allowed(6)).when(size <= 9, slips_allowed(9)).otherwise(slips_allowed(10))


def _may_be_near() -> Column:
    """Whether text and k_text may be within the slips allowed: a slip is two plain edits at most, so nothing is lost."""
    slips = _most_slips("k_text")
    edits = F.levenshtein("text", "k_text", 2 * slips_allowed(10))
    return (F.abs(F.length("text") - F.length("k_text")) <= slips) & (edits >= 0) & (edits <= 2 * slips)


class History:
    """The accepted records: a row of facts per record and form, and the band keys with signatures of their texts.

    Both are tables in a folder that all executors share, `facts` partitioned by hash of the text and `keys` by hash of
    the key; `layout` names the parts and how many texts were appended since they were laid out.
    """

    FACTS = "record long, form string, text string, kind string, rank int, city_id long, country_id long, unlisted boolean, entity_type string"
    KEYS = "key long, text string, city_id long, sign_a long, sign_b long"

    def __init__(self, spark, where: str | None = None):
        self.spark, self.where = spark, (where or scratch_path(spark, "history")).rstrip("/")
        try:
            last = spark.read.schema("version int, parts int, texts long").parquet(f"{self.where}/layout").orderBy(F.desc("version")).first()
        except AnalysisException:  # no such folder yet
            last = None
        self.version, self.parts, self.texts = tuple(last) if last else (0, 0, 0)

    def _noted(self) -> None:
        self.spark.createDataFrame([(self.version, self.parts, self.texts)], "version int, parts int, texts long").coalesce(1).write.mode("append").parquet(f"{self.where}/layout")

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, name: str, column: str) -> None:
        # one file per part and call, ordered, so that a reader skips what it can't meet
        df = df.withColumn("part", self._part(column)).repartition(self.parts, "part").sortWithinPartitions("part", column)
        df.write.mode("append").partitionBy("part").parquet(f"{self.where}/{name}-{self.parts}")

    def _read(self, name: str, schema: str, parts: list[int] | None) -> DataFrame:
        df = self.spark.read.schema(schema + ", part int").parquet(f"{self.where}/{name}-{self.parts}")
        return (df if parts is None else df.where(F.col("part").isin(parts))).drop("part")

    def append(self, forms: DataFrame, keys: DataFrame | None = None) -> None:
        """Add accepted records: a row per form with the columns of FACTS, and the entries of their texts if made already."""
        forms = forms.select(*[c.split()[0] for c in self.FACTS.split(", ")])
        texts = forms.select("text", "city_id").distinct().count()
        keys = entries(forms) if keys is None else keys
        old = self.parts
        self.version, self.texts = self.version + 1, self.texts + texts
        if not old or self.texts > GROWTH * old * PART_TEXTS:
            self.parts = max(16, -(-self.texts // PART_TEXTS))
            if old:
                old_facts, old_keys = (f"{self.where}/{name}-{old}" for name in ("facts", "keys"))
                forms = forms.unionByName(self.spark.read.schema(self.FACTS + ", part int").parquet(old_facts).drop("part"))
                keys = keys.unionByName(self.spark.read.schema(self.KEYS + ", part int").parquet(old_keys).drop("part"))
        self._write(forms, "facts", "text")
        self._write(keys, "keys", "key")
        self._noted()

    def met(self, probes: DataFrame) -> DataFrame:
        """Entries of the parts that hold a key of `probes` (the number of parts bounds what is collected)."""
        if not self.parts:
            return self.spark.createDataFrame([], self.KEYS)
        return self._read("keys", self.KEYS, [r.part for r in probes.select(self._part("key").alias("part")).distinct().collect()])

    def facts(self, texts: DataFrame | None = None) -> DataFrame:
        """Facts of all records, or the parts of those that may be known by one of `texts` (k_text)."""
        if not self.parts:
            return self.spark.createDataFrame([], self.FACTS)
        some = None if texts is None else [r.part for r in texts.select(self._part("k_text").alias("part")).distinct().collect()]
        return self._read("facts", self.FACTS, some)


def near_texts(probes: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a typed and a known text that meet in a key and are verified: text, city_id, k_text, k_city_id, slips.

    A text of another city is none; the keys of pairs of up to two slips hold no city.
    """
    k = known.withColumnsRenamed({c: "k_" + c for c in ("text", "city_id", "sign_a", "sign_b")})
    apart = F.bit_count(F.col("sign_a").bitwiseXOR(F.col("k_sign_a"))) + F.bit_count(F.col("sign_b").bitwiseXOR(F.col("k_sign_b")))
    places = (F.col("city_id") == F.col("k_city_id")) | (F.col("city_id") == 0) | (F.col("k_city_id") == 0)
    met = probes.join(k, "key").where(places & (apart <= BITS_APART) & _may_be_near()).select("text", "city_id", "k_text", "k_city_id").distinct()
    return met.withColumn("slips", _slips("text", "k_text", _most_slips("k_text"))).where(F.col("slips") <= _most_slips("k_text"))


def _verified(near: DataFrame, queries: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (record, batch_no, known, k_batch_no, cost) of typed and known records that are the same entity."""
    k = known.select(*[F.col(c).alias("k_" + c if c != "record" else "known") for c in known.columns])
    pairs = near.join(queries, ["text", "city_id"]).join(k, ["k_text", "k_city_id"])
    size = F.length("text")
    fits = (
        ((F.col("form") == "full") & (F.col("k_form") == "full"))
        | ((F.col("form") == "full") & (F.col("k_form") == "short") & (F.col("slips") <= F.when(size >= 7, 1).otherwise(0)))
        | ((F.col("form") == "short") & (F.col("k_form") == "full") & (F.col("slips") == 0) & (F.col("k_kind") == "") & (F.col("turn") <= 1))
        | ((F.col("form") == F.col("k_form")) & F.col("form").startswith("last"))
        | ((F.col("form") == "surname") & (F.col("k_form") == "surname"))
    )
    kinds = (F.col("kind") == "") | (F.col("k_kind") == "") | (F.col("kind") == F.col("k_kind"))
    typed = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("unknown", "")
    types = ((F.col("kind") != "") & (F.col("k_kind") != "")) | ~typed("entity_type") | ~typed("k_entity_type") | (F.col("entity_type") == F.col("k_entity_type"))
    in_city = (F.col("city_id") > 0) & (F.col("city_id") == F.col("k_city_id"))
    cities = in_city | (F.col("city_id") == 0) | (F.col("k_city_id") == 0)
    listed = F.col("unlisted") == F.col("k_unlisted")
    lands = (F.col("country_id") == 0) | (F.col("k_country_id") == 0) | (F.col("country_id") == F.col("k_country_id"))
    same_kind = (F.col("kind") != "") & (F.col("kind") == F.col("k_kind"))
    cost = (
        F.col("slips") * 2 + F.when(F.col("k_form") == "full", 0).otherwise(3) + F.when(same_kind, 0).otherwise(1)
        + F.when(F.col("turn") > 0, 1).otherwise(0) + F.col("k_rank") - F.when(in_city, 1).otherwise(0)
    )
    sure = (F.col("slips") <= 2) | (in_city & same_kind)
    order = (F.col("known") < F.col("record")) & (F.col("k_batch_no").isNull() | (F.col("k_batch_no") <= F.col("batch_no")))
    good = pairs.where(order & fits & kinds & types & cities & lands & listed & sure)
    return good.groupBy("record", "batch_no", "known", "k_batch_no").agg(F.min(cost).alias("cost"))


def repetitions(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """Records of `pairs` that are repetitions once the batches are taken in order: record.

    A record is one if it has a partner in the history, in its own batch, or one of an earlier batch that was accepted
    itself. Each round decides all records whose earlier partners are decided, so the rounds are the longest row of
    batches through which decisions hang together, two or three as a rule; lineage is cut every round.
    """
    sure = F.max(F.coalesce(F.col("k_batch_no") == F.col("batch_no"), F.lit(True)))
    first = cut_lineage(pairs.groupBy("record").agg(sure.alias("sure")))
    told = first.where("sure").select("record", F.lit(True).alias("again"))
    left = pairs.join(first.where("not sure"), "record", "left_semi").select("record", "known")
    for _ in range(rounds):
        if not left.limit(1).count():
            return told.where("again").select("record")
        open_ = left.select("record").distinct().select(F.col("record").alias("known"), F.lit(True).alias("open"))
        seen = left.join(open_, "known", "left").join(told.withColumnRenamed("record", "known"), "known", "left")
        # a partner that is neither open nor told to be a repetition was accepted
        accepted = F.max(F.col("open").isNull() & ~F.coalesce("again", F.lit(False)))
        now = cut_lineage(seen.groupBy("record").agg(accepted.alias("again"), F.max(F.coalesce("open", F.lit(False))).alias("waits")))
        decided = now.where("again or not waits").select("record", "again")
        told = told.unionByName(decided)
        left = cut_lineage(left.join(decided, "record", "left_anti"))
    raise RuntimeError(f"batches not settled after {rounds} rounds")


def settled(root: DataFrame, rounds: int = 40) -> DataFrame:
    """`root` (record, known, near) with every chain of near followed to its first record, or to what that is known as.

    Links double each round, so chains take logarithmic time; lineage is cut every round.
    """
    for _ in range(rounds):
        up = root.select(F.col("record").alias("near"), F.col("known").alias("up_known"), F.col("near").alias("up_near"))
        known = F.coalesce("known", "up_known")
        root = cut_lineage(root.join(up, "near", "left").select(
            "record", known.alias("known"), F.when(known.isNull(), F.coalesce("up_near", "near")).alias("near"),
            (F.col("up_known").isNotNull() | F.col("up_near").isNotNull()).alias("moved"),
        ))
        moved = root.where("moved").limit(1).count()
        root = root.drop("moved")
        if not moved:
            return root
    raise RuntimeError(f"chains of a batch not settled after {rounds} rounds")


def verdicts(pairs: DataFrame) -> DataFrame:
    """Each repetition with the record it repeats: record, known_id."""
    pairs = materialize(pairs, "pairs")
    again = materialize(repetitions(pairs), "repetitions")
    mine = F.coalesce(F.col("k_batch_no") == F.col("batch_no"), F.lit(False))
    # what an earlier batch repeated isn't in the index; a partner in the own batch stands for what it is itself
    open_ = pairs.join(again.select(F.col("record").alias("known"), F.lit(True).alias("gone")), "known", "left").where(mine | F.col("gone").isNull())
    ranked = F.struct("cost", "known")
    best = open_.groupBy("record").agg(F.min(F.when(~mine, ranked)).alias("k"), F.min(F.when(mine, ranked)).alias("n"))
    best = best.select("record", F.col("k.known").alias("known"), F.when(F.col("k").isNull(), F.col("n.known")).alias("near"))
    return settled(best).select("record", F.coalesce("known", "near").alias("known_id")).where("known_id is not null")


def deduplicate(intake: DataFrame, canonical: DataFrame | None, places: DataFrame, where: str | None = None) -> DataFrame:
    """Every intake row once with its verdict: intake_id, batch_no, known_id (null: new).

    The index is left in `where` (a folder of its own in the shared folder by default) for batches to come; records that
    it holds already, of canonical or of the intake, aren't appended again. `canonical` may be None from the second call on.
    """
    spark = intake.sparkSession
    history = History(spark, where)
    if canonical is not None:
        base = entities_of(canonical)
        if history.parts:
            base = base.join(history.facts().select(F.col("record").alias("entity_id")), "entity_id", "left_anti")
        facts = known_forms(base).withColumnsRenamed({"entity_id": "record", "known": "text"})
        at = listed_city(base, places).withColumnsRenamed({"entity_id": "record", "e_city": "city_id", "e_country": "country_id"})
        types = base.select(F.col("entity_id").alias("record"), "entity_type")
        facts = materialize(facts.join(at, "record").join(types, "record").withColumn("unlisted", F.lit(False)), "facts")
        history.append(facts)

    rows = intake.dropDuplicates(["intake_id"]).select(
        F.col("intake_id").alias("record"), F.coalesce("batch_no", F.lit(2**31 - 1)).cast("int").alias("batch_no"),
        F.col("entity_name").alias("name"), "entity_type", "location", "city", "country",
    )
    rows = with_place(rows, places, "name").withColumn("unlisted", F.col("place_status") == "unlisted")
    # equal rows of a batch are looked up once, by their first record
    equal = Window.partitionBy("batch_no", "name", "entity_type", "city_id", "country_id", "unlisted").orderBy("record")
    rows = rows.withColumn("first", F.first("record").over(equal)).select("record", "first", "batch_no", "name", "entity_type", "city_id", "country_id", "unlisted")
    rows = materialize(rows, "intake")
    leads = rows.where("record = first")
    typed = typed_forms(leads.select("name")).withColumnRenamed("query", "text")
    kept = materialize(leads.join(typed, "name").drop("name", "first"), "typed")
    forms = known_forms(leads.select(F.col("record").alias("entity_id"), "name", F.array().cast("array<string>").alias("aliases")))
    own = forms.withColumnsRenamed({"entity_id": "record", "known": "text"}).join(leads.drop("name", "first"), "record")
    own = materialize(own, "own")
    probes, own_keys = materialize(entries(kept, probe=True), "probes"), materialize(entries(own), "own-keys")

    near = materialize(near_texts(probes, history.met(probes).unionByName(own_keys)), "near")
    known = history.facts(near).withColumn("batch_no", F.lit(None).cast("int")).unionByName(own.select(*history.facts().columns, "batch_no"))
    told = materialize(verdicts(_verified(near, kept, known)), "told")
    fresh = materialize(own.join(told, "record", "left_anti").drop("batch_no"), "fresh")
    history.append(fresh, own_keys.join(fresh.select("text", "city_id").distinct(), ["text", "city_id"], "left_semi"))

    out = rows.join(told.withColumnRenamed("record", "first"), "first", "left")
    named = kept.select(F.col("record").alias("first")).distinct().withColumn("named", F.lit(True))
    # an equal row after the first repeats what the first is
    out = out.join(named, "first", "left")
    known_id = F.coalesce("known_id", F.when((F.col("record") > F.col("first")) & F.col("named"), F.col("first")))
    return out.select(F.col("record").alias("intake_id"), "batch_no", known_id.alias("known_id"))


def found(intake: DataFrame, canonical: DataFrame, places: DataFrame) -> DataFrame:
    """p4_found: intake rows whose entity is already known, with the smallest id that brought it."""
    return deduplicate(intake, canonical, places).where("known_id is not null").select("known_id", F.col("intake_id").alias("new_id"))
