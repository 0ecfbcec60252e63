"""Problem 3: the best representative of each duplicate group, field by field.

Method: Bayesian fusion with copy detection. Every record claims a value of each field; the runs that wrote the records
are the sources. Source accuracies and value posteriors are estimated in turn over all fields; two sources that share
values, false ones above all, more often and differ less often than independent ones would are taken as dependent, and a
vote that a dependent source gave before is discounted by that. What is known of the form of a right value (names:
spelling, age; latitudes: precision and distance from the city's listed centre) enters as the weight of the votes, since
a damaged, stale or stand-in value says little of its source's knowledge, and as a small prior. Each field takes its
value of highest posterior, or none where that of "none of the values claimed" (NONE) is higher.

Votes are pre-aggregated by item and value into sets of sources (bounded by the number of sources), and values of source
pairs are counted as partial matrices per partition, so neither a group of a third of all rows nor its pairs are ever in
one place. Every source has an accuracy, and every two that meet in an item a dependence, of their own: up to MAX_SOURCES
sources they are matrices, beyond that the same figures are tables, and the pairs of one item are many tasks' work.

Defined results: null, blank and generic values claim nothing; a group without any right-looking name (latitude) has 0;
ties go to the value claimed by more records, then to the smaller; repeated record_ids count once; a null group_id is left
out; a null run_id or updated_at is a source, or a time, of its own (the oldest).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.names import KINDS, NICKNAMES, parse
from tidemark.llm.places import place_form
from tidemark.llm.spelling import plain, sound, within
from tidemark.session import materialize

#: Sources (runs) whose pairs are held as matrices; of more they are held as tables, with the same results.
MAX_SOURCES = 1000
#: Sources of one side of two chunks of an item whose pairs are told at once.
PAIR_CHUNK = 256
#: Accuracy of a source of which nothing is known, and the claims that this counts as.
UNKNOWN, UNKNOWN_CLAIMS = 0.7, 4
#: False values that a field is assumed to have, and the chance that a dependent source copies a value.
FALSE_VALUES, COPIES = 20, 0.8
#: Prior chance that two sources are dependent.
DEPENDENT = 0.1
#: Rounds of estimating accuracies and posteriors in turn.
ROUNDS = 3
#: Degrees from the centre of its city within which an entity lies.
NEAR = 0.6
#: Weight of a vote for a value of a damaged, stale or stand-in form, and the prior log odds of such a value.
DOUBTFUL, DOUBT = 0.05, -3.0
#: Log odds of "none of the values claimed", which has no votes.
NONE = 1.0

_KIND_WORDS = {w for kind in KINDS for w in kind.split()}


def name_defects(name: str) -> int:
    """How many marks of a damaged name a name bears: 0 for one that may be right."""
    text = name.strip()
    parts = parse(text)
    if not parts.core or plain(text) in ("unknown", "none", "n a", "null", "tbd"):
        return 9
    words = text.split(" ")
    out = 0
    out += name != text or "  " in name
    out += any(c in text for c in "_#@\"…|*!?()") or "..." in text or "," in text
    out += bool(re.search("[Â-Ã][\u0080-¿]", text)) or "�" in text
    out += not all(w[:1].isupper() and w[1:] == w[1:].lower() or "-" in w for w in words if w)
    out += plain(words[0]) in ("the", "old", "famous", "visit", "best", "our", "guide", "mx", "a", "my")
    out += plain(words[-1]) in ("vlog", "again")
    out += any(not (c.isalnum() or c in " '-’." or "̀" <= c <= "ͯ") for c in text)
    kind_said = [w for w in words if plain(w) in _KIND_WORDS]
    if parts.kind:
        out += len(kind_said) < len(parts.kind.split())
        out += "-" in text
        # the kind stands last, only a hotel's may stand first
        at = [plain(w) for w in words]
        kind = parts.kind.split()
        out += not (at[-len(kind) :] == kind or (kind == ["hotel"] and at[0] == "hotel"))
    elif len(words) != 2 or plain(words[0]) not in NICKNAMES:
        out += 1
    return out


def variant_of(a: str, b: str) -> bool:
    """Whether two names are spellings of one name: equal core by sound, one core a part of the other, or a few slips."""
    x, y = parse(a), parse(b)
    if not x.core or not y.core:
        return True
    s, t = sound("".join(x.core)), sound("".join(y.core))
    if x.person or y.person:
        s, t = sound("".join(sorted(x.core))), sound("".join(sorted(y.core)))
    k = 3 if min(len(s), len(t)) > 6 else 2
    short = min(len(s), len(t)) >= 4 and (s.startswith(t) or t.startswith(s))
    return short or within(s, t, k) <= k


def _name_claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["group_id", "record_id", "source", "seen", "value", "weight", "defects", "old"]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            name = r.canonical_name if isinstance(r.canonical_name, str) else ""
            aliases = [a for a in (r.aliases if r.aliases is not None else []) if isinstance(a, str) and a.strip()]
            own = name_defects(name) if name.strip() else 9
            if own < 9:
                out.append((r.group_id, r.record_id, r.source, r.seen, name, 1.0, own, False))
            for alias in dict.fromkeys(aliases):
                bad = name_defects(alias)
                # beside a damaged spelling of itself an alias is the name; beside another good name it is a former one
                former = own == 0 and bad <= 1 and alias != name and not variant_of(name, alias)
                if bad == 0 or former:
                    out.append((r.group_id, r.record_id, r.source, r.seen, alias, 0.8, bad, former))
        yield pd.DataFrame(out, columns=names)


def records_of(snapshots: DataFrame) -> DataFrame:
    """Each record once, with source (the run) and seen (a number that rises with updated_at)."""
    rows = snapshots.where("group_id is not null and record_id is not null").dropDuplicates(["record_id"])
    return rows.withColumns({"source": F.coalesce("run_id", F.lit("")), "seen": F.coalesce(F.unix_timestamp(F.col("updated_at").cast("timestamp")), F.lit(0))})


def _pair_counts(index: dict[str, int], size: int):
    """Counts of source pairs that share a false (0) or a true (1) value, or claim one item at all (2), per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((3, size, size), np.float32)
        for pdf in batches:
            for sources, kind in zip(pdf["sources"], pdf["kind"], strict=True):
                ids = np.array(sorted(index[s] for s in sources), np.int64)
                if len(ids) > 1:
                    counts[kind][np.ix_(ids, ids)] += 1
        for kind in range(3):
            a, b = np.nonzero(np.triu(counts[kind], 1))
            yield pd.DataFrame({"kind": np.full(len(a), kind), "a": a, "b": b, "n": counts[kind][a, b].astype(float)})

    return run


def _votes(shared):
    """Column function of a value's log posterior (but for a constant): prior and discounted votes of its sources."""

    def run(sources: pd.Series, weight: pd.Series, prior: pd.Series) -> pd.Series:
        index, accuracy, depends = shared.value
        totals = []
        for some, w, p in zip(sources, weight, prior, strict=True):
            ids = sorted((index[s] for s in some), key=lambda i: (-accuracy[i], i))
            total = 0.0
            for at, i in enumerate(ids):
                # a vote counts by the chance that it wasn't copied from one counted before
                alone = float(np.prod(1 - COPIES * depends[i, ids[:at]])) if at else 1.0
                total += alone * np.log(FALSE_VALUES * accuracy[i] / (1 - accuracy[i]))
            totals.append(p + w * total)
        return pd.Series(totals, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


class _Matrices:
    """Accuracies and dependences of at most MAX_SOURCES sources, as arrays."""

    def __init__(self, values: DataFrame, names: list[str]):
        self.spark, self.index, self.size = values.sparkSession, {s: i for i, s in enumerate(names)}, len(names)
        self.named = F.create_map(*[F.lit(x) for s, i in self.index.items() for x in (s, i)]) if names else F.create_map().cast("map<string,int>")
        self.accuracy, self.depends = np.full(self.size, UNKNOWN), np.zeros((self.size, self.size), np.float32)

    def scored(self, values: DataFrame) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((self.index, self.accuracy.copy(), self.depends.copy()))
        return values.withColumn("score", _votes(shared)("sources", "weight", "prior"))

    def learn(self, out: DataFrame, counts: DataFrame, trusted: bool) -> None:
        number = F.try_element_at(self.named, F.col("source"))
        seen = [] if not trusted else out.select("posterior", F.explode("sources").alias("source")).groupBy(number.alias("i")).agg(F.avg("posterior").alias("a"), F.count("*").alias("n")).collect()
        for r in seen:
            self.accuracy[r.i] = min(0.98, max(0.3, (r.a * r.n + UNKNOWN * UNKNOWN_CLAIMS) / (r.n + UNKNOWN_CLAIMS)))
        pairs = counts.mapInPandas(_pair_counts(self.index, self.size), "kind int, a int, b int, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
        together = np.zeros((3, self.size, self.size))
        for r in pairs:
            together[r.kind, r.a, r.b] = together[r.kind, r.b, r.a] = r.n
        if trusted:
            self.depends = dependence(together, self.accuracy)
        else:
            together[1] += together[0]
            self.depends = dependence(together * [[[0.0]], [[1.0]], [[1.0]]], np.full(self.size, _accuracy_by_agreement(together)))


def source_pairs(sets: DataFrame, *keep: str) -> DataFrame:
    """Each pair of `sources` (a < b) of each row with the columns `keep`; the pairs of a long row are spread by chunks."""
    rows = sets.where(F.size("sources") > 1).withColumn("sources", F.array_sort("sources"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("sources") / PAIR_CHUNK).cast("int") - 1), lambda k: F.slice("sources", k * PAIR_CHUNK + 1, PAIR_CHUNK))
    rows = rows.withColumn("chunks", chunks).select(*keep, "chunks", F.posexplode("chunks").alias("i", "x"))
    rows = rows.select(*keep, "x", F.explode(F.slice("chunks", F.col("i") + 1, F.size("chunks"))).alias("y"))
    rows = rows.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*keep, "y", F.explode("x").alias("a")).select(*keep, "a", F.explode("y").alias("b")).where("a < b")


class _Tables:
    """The same for any number of sources, as tables: accuracy (source, accuracy) and loss (a, b, later, loss).

    `later` is the one of the two whose vote is counted after the other's, `loss` the logarithm of what that leaves of it.
    """

    def __init__(self):
        self.accuracy = self.loss = None

    def scored(self, values: DataFrame) -> DataFrame:
        key = ["field", "group_id", "value"]
        vote = lambda a: F.log(FALSE_VALUES * a / (1 - a))
        if self.loss is None:
            return values.withColumn("score", F.col("prior") + F.col("weight") * F.size("sources") * vote(F.lit(UNKNOWN)))
        lost = source_pairs(values, *key).join(self.loss, ["a", "b"]).groupBy(*key, F.col("later").alias("source")).agg(F.sum("loss").alias("loss"))
        votes = values.select(*key, F.explode("sources").alias("source")).join(lost, [*key, "source"], "left")
        if self.accuracy is not None:
            votes = votes.join(self.accuracy, "source")
        weight = vote(F.col("accuracy") if self.accuracy is not None else F.lit(UNKNOWN))
        total = votes.groupBy(*key).agg(F.sum(F.exp(F.coalesce("loss", F.lit(0.0))) * weight).alias("total"))
        # rounded, so that equal votes are equal in whatever order they are added
        return values.join(total, key).withColumn("score", F.round(F.col("prior") + F.col("weight") * F.col("total"), 9)).drop("total")

    def learn(self, out: DataFrame, counts: DataFrame, trusted: bool) -> None:
        if trusted:
            seen = out.select("posterior", F.explode("sources").alias("source")).groupBy("source").agg(F.avg("posterior").alias("p"), F.count("*").alias("n"))
            mean = (F.col("p") * F.col("n") + UNKNOWN * UNKNOWN_CLAIMS) / (F.col("n") + UNKNOWN_CLAIMS)
            self.accuracy = materialize(seen.select("source", F.least(F.lit(0.98), F.greatest(F.lit(0.3), mean)).alias("accuracy")), "accuracies")
        false, true, both = (F.count(F.when(F.col("kind") == k, 1)).cast("double") for k in range(3))
        pairs = source_pairs(counts, "kind").groupBy("a", "b").agg(false.alias("false"), true.alias("true"), both.alias("both"))
        if trusted:
            of = lambda s: self.accuracy.select(F.col("source").alias(s), F.col("accuracy").alias("accuracy_" + s))
            pairs = pairs.join(of("a"), "a").join(of("b"), "b")
        else:
            pairs = materialize(pairs.withColumns({"true": F.col("false") + F.col("true"), "false": F.lit(0.0)}), "source-pairs")
            agree = pairs.agg(F.median(F.col("true") / F.col("both"))).first()[0]
            a = UNKNOWN if agree is None else float(np.clip(np.sqrt(agree), 0.5, 0.98))
            pairs = pairs.withColumns({"accuracy_a": F.lit(a), "accuracy_b": F.lit(a)})
        a, b = F.col("accuracy_a"), F.col("accuracy_b")
        # as in dependence()
        same_true, same_false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
        copy_true, copy_false = COPIES * (a + b) / 2 + (1 - COPIES) * same_true, COPIES * (1 - (a + b) / 2) + (1 - COPIES) * same_false
        differ = F.greatest(F.col("both") - F.col("false") - F.col("true"), F.lit(0.0))
        gain = F.col("false") * F.log(copy_false / same_false) + F.col("true") * F.log(copy_true / same_true) + differ * float(np.log(1 - COPIES))
        sure = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.lit(float(np.log(DEPENDENT / (1 - DEPENDENT)))) + gain))
        loss = F.log1p(-COPIES / (1 + F.exp(-sure)))
        self.loss = materialize(pairs.select("a", "b", F.when(a >= b, F.col("b")).otherwise(F.col("a")).alias("later"), loss.alias("loss")), "losses")


def fuse(claims: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Posterior of every value of every item: field, group_id, value, records, posterior, best.

    `claims` has field, group_id (together the item), record_id, source, value, weight (of the vote) and prior (log odds
    of the value's form). `best` is false for all values of an item that NONE outweighs.
    """
    item = ["field", "group_id"]
    values = claims.groupBy(*item, "value").agg(
        F.collect_set("source").alias("sources"), F.countDistinct("record_id").alias("records"), F.max("prior").alias("prior"), F.max("weight").alias("weight")
    )
    values = materialize(values, "fusion-values")
    names = sorted(r.source for r in values.select(F.explode("sources").alias("source")).distinct().limit(MAX_SOURCES + 1).collect())
    known = _Matrices(values, names) if len(names) <= MAX_SOURCES else _Tables()
    out = values
    for turn in range(rounds):
        scored = known.scored(values)
        if isinstance(known, _Tables):
            scored = materialize(scored, f"fusion-scores-{turn}")
        top = scored.groupBy(*item).agg(F.max(F.struct("score", "records", F.col("value").alias("best_value"))).alias("b"), F.collect_list("score").alias("scores"))
        # all scores beside that of NONE; their number is that of the different values of one item
        peak = F.greatest(F.col("b.score"), F.lit(NONE))
        norm = F.aggregate("scores", F.exp(F.lit(NONE) - peak), lambda total, x: total + F.exp(x - peak))
        top = top.select(*item, "b.best_value", peak.alias("peak"), norm.alias("norm"))
        out = scored.join(top, item).select(
            *item, "value", "sources", "records", (F.exp(F.col("score") - F.col("peak")) / F.col("norm")).alias("posterior"),
            ((F.col("value") == F.col("best_value")) & (F.col("score") > NONE)).alias("best"),
        )
        if turn == rounds - 1 or not names:
            break
        out = materialize(out, f"fusion-{turn}")
        both = out.groupBy(*item).agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources")).select("sources", F.lit(2).alias("kind"))
        counts = out.select("sources", F.col("best").cast("int").alias("kind")).unionByName(both).where(F.size("sources") > 1)
        # the first votes may follow the copiers: what they say of accuracies isn't used, only who agrees with whom
        known.learn(out, counts, trusted=turn > 0)
    return out


def _accuracy_by_agreement(together: np.ndarray) -> float:
    """The accuracy at which two independent sources would agree as often as the median pair does."""
    both = together[2] > 0
    return float(np.clip(np.sqrt(np.median(together[1][both] / together[2][both])), 0.5, 0.98)) if both.any() else 0.7


def dependence(together: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Posterior chance of dependence of each pair of sources, from the items on which they share false values, true ones, or none."""
    a, b = accuracy[:, None], accuracy[None, :]
    same_true, same_false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    copy_true, copy_false = COPIES * (a + b) / 2 + (1 - COPIES) * same_true, COPIES * (1 - (a + b) / 2) + (1 - COPIES) * same_false
    differ = np.maximum(together[2] - together[0] - together[1], 0)
    gain = together[0] * np.log(copy_false / same_false) + together[1] * np.log(copy_true / same_true) + differ * np.log(1 - COPIES)
    p = 1 / (1 + np.exp(-np.clip(np.log(DEPENDENT / (1 - DEPENDENT)) + gain, -30, 30)))
    p[together[2] == 0] = 0.0
    np.fill_diagonal(p, 0.0)
    return p.astype(np.float32)


def name_claims(records: DataFrame) -> DataFrame:
    """Claims of names; a name that a later record calls former, or that only older records bear, is discounted."""
    rows = records.select(
        "group_id", "record_id", "source", "seen", "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")
    ).mapInPandas(
        _name_claims, "group_id long, record_id long, source string, seen long, value string, weight double, defects int, old boolean"
    )
    rows = materialize(rows, "name-claims")
    former = rows.where("old").select("group_id", "value").distinct().withColumn("former", F.lit(True))
    rows = rows.where("not old").join(former, ["group_id", "value"], "left")
    # a vote for a former name is older than the change; accents get lost but don't appear
    doubtful = (F.col("defects") > 0) | F.coalesce("former", F.lit(False))
    prior = F.when(doubtful, DOUBT).otherwise(0.0) - F.least("defects", F.lit(4)) + F.when(F.col("value").rlike("[^\\x00-\\x7F]"), 2.5).otherwise(0.0)
    return rows.withColumns({"field": F.lit("name"), "prior": prior, "weight": F.col("weight") * F.when(doubtful, DOUBTFUL).otherwise(1.0)})


def city_centres(records: DataFrame, places: DataFrame) -> DataFrame:
    """Listed centre of each group's city, by the votes of its records: group_id, c_lat, c_lon (null where no city is listed)."""
    votes = records.where("length(trim(city)) > 0").groupBy("group_id", "city").agg(F.count("*").alias("n"))
    land = records.where("length(trim(country)) > 0").groupBy("group_id", "country").agg(F.count("*").alias("m"))
    land = land.groupBy("group_id").agg(F.max(F.struct("m", "country")).alias("k")).select("group_id", F.col("k.country").alias("land"))
    key = F.pandas_udf(lambda s: s.map(lambda x: place_form(x)[1]), "string")
    listed = places.where("kind = 'city'").select(key("city").alias("key"), F.col("country").alias("of"), F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))
    found = votes.withColumn("key", key("city")).join(listed, "key").join(land, "group_id", "left")
    right = F.when(F.col("land") == F.col("of"), 1).otherwise(0)
    return found.groupBy("group_id").agg(F.max(F.struct("n", right.alias("right"), "key", "c_lat", "c_lon")).alias("c")).select("group_id", "c.c_lat", "c.c_lon")


def latitude_claims(records: DataFrame, places: DataFrame) -> DataFrame:
    """Claims of latitudes; centres of cities, whole degrees and places far from the city are discounted."""
    rows = records.where("latitude is not null and not isnan(latitude)").join(city_centres(records, places), "group_id", "left")
    lat, lon = F.col("latitude"), F.col("longitude")
    centre = (F.abs(lat - F.col("c_lat")) < 0.00006) & (F.abs(lon - F.col("c_lon")) < 0.00006)
    whole = (lat == F.round(lat)) & (lon.isNull() | (lon == F.round(lon)))
    off = (F.abs(lat - F.col("c_lat")) > NEAR) | (F.abs(lon - F.col("c_lon")) > NEAR)
    doubtful = centre | whole | F.coalesce(off, F.lit(False)) | (F.abs(lat) > 90) | ((lat == 0) & (lon == 0))
    doubtful = F.coalesce(doubtful, F.lit(False))
    trust = F.when(F.col("geocoding_source") == "google_maps", 1.0).when(F.col("geocoding_source") == "nominatim", 0.9).otherwise(0.7)
    return rows.select(
        F.lit("latitude").alias("field"), "group_id", "record_id", "source", "seen", F.format_string("%.5f", lat).alias("value"),
        (trust * F.when(doubtful, DOUBTFUL).otherwise(1.0)).alias("weight"), F.when(doubtful, DOUBT).otherwise(0.0).alias("prior"), "latitude", "longitude",
    )


def plain_claims(records: DataFrame, field: str) -> DataFrame:
    """Claims of a field of words: as written, blank and unknown ones left out."""
    rows = records.where((F.length(F.trim(field)) > 0) & (F.lower(F.trim(field)) != "unknown"))
    return rows.select(F.lit(field).alias("field"), "group_id", "record_id", "source", F.col(field).alias("value"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("prior"))


_CLAIM = ["field", "group_id", "record_id", "source", "value", "weight", "prior"]


def fused_fields(names: DataFrame, lats: DataFrame, records: DataFrame) -> DataFrame:
    """The chosen value of every field of every group that has one: field, group_id, value, posterior."""
    claims = names.select(*_CLAIM).unionByName(lats.select(*_CLAIM))
    for field in ("entity_type", "city", "country"):
        claims = claims.unionByName(plain_claims(records, field))
    return materialize(fuse(claims).where("best").select("field", "group_id", "value", "posterior"), "fused")


def found(snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """p3_found: per group the smallest record_id with the right name, and with the right latitude (0: none)."""
    records = materialize(records_of(snapshots), "records")
    lats = materialize(latitude_claims(records, places), "latitudes")
    fused = fused_fields(name_claims(records), lats, records)
    name, lat = (fused.where(F.col("field") == f).select("group_id", F.col("value").alias("best")) for f in ("name", "latitude"))
    by_name = records.join(name, "group_id").where(F.col("canonical_name") == F.col("best")).groupBy("group_id").agg(F.min("record_id").alias("name_record"))
    by_lat = lats.join(lat, "group_id").where(F.col("value") == F.col("best")).groupBy("group_id").agg(F.min("record_id").alias("latitude_record"))
    groups = records.select("group_id").distinct()
    return groups.join(by_name, "group_id", "left").join(by_lat, "group_id", "left").fillna(0).select("group_id", "name_record", "latitude_record")


def survivors(snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """One surviving record per group, built field by field.

    group_id, canonical_name, aliases (all other good names, sorted), entity_type, city, country, latitude, longitude,
    total_mentions (most), updated_at (latest), name_posterior, latitude_posterior.
    """
    records = materialize(records_of(snapshots), "records")
    claims = name_claims(records)
    lats = materialize(latitude_claims(records, places), "latitudes")
    fused = fused_fields(claims, lats, records)
    fields = ("name", "latitude", "entity_type", "city", "country")
    wide = fused.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "posterior"))).alias(f"_{f}") for f in fields])
    at = lats.join(wide.select("group_id", F.col("_latitude.value").alias("best")), "group_id").where(F.col("value") == F.col("best"))
    at = at.groupBy("group_id").agg(F.min(F.struct("record_id", "latitude", "longitude")).alias("g"))
    others = claims.where("defects = 0").groupBy("group_id").agg(F.sort_array(F.collect_set("value")).alias("all_names"))
    base = records.groupBy("group_id").agg(F.max("total_mentions").alias("total_mentions"), F.max("updated_at").alias("updated_at"))
    out = base.join(wide, "group_id", "left").join(others, "group_id", "left").join(at, "group_id", "left").withColumn("canonical_name", F.col("_name.value"))
    return out.select(
        "group_id", "canonical_name", F.array_remove(F.coalesce("all_names", F.array().cast("array<string>")), F.coalesce("canonical_name", F.lit(""))).alias("aliases"),
        *[F.col(f"_{f}.value").alias(f) for f in ("entity_type", "city", "country")], "g.latitude", "g.longitude", "total_mentions", "updated_at",
        F.col("_name.posterior").alias("name_posterior"), F.col("_latitude.posterior").alias("latitude_posterior"),
    )
