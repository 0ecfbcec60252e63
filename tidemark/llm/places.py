"""Problem 1: free-entered places mapped to a canonical list.

Method: prefix-filter set-similarity join. Every typed value is cut into segments, every distinct segment and
every listed spelling becomes a set of letter pairs, the pairs are ordered by rarity in the list, only the rare
prefixes are joined, length and positional filters drop hopeless pairs, Jaccard is computed exactly on the rest
and the best entry is kept. Only distinct segments are compared, so a hot city costs one comparison.

Defined results: a triple whose three values are all null or blank names nothing (status 'none', place_id 0);
an empty `places` list leaves every named value 'unlisted' or 'none'; ties between listed places go to the
smaller place_id; repeated rows get equal results; very long values are cut into segments like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.spelling import grams, plain, sound, within, within_many
from tidemark.session import materialize

#: Jaccard similarity of letter pairs from which a segment is compared further.
MIN_JACCARD = 0.25

# Words around a place name that are no part of it.
_BEFORE = {"near", "around", "in", "at", "downtown", "greater", "central", "old", "the", "city", "of", "town"}
_AFTER = {"city", "centre", "center", "country", "town", "old", "area", "region"}
_SHORT_FIRST = {"st": "saint", "ste": "saint", "pt": "port", "prt": "port", "mt": "mount", "ft": "fort"}
_SHORT_LAST = {"b": "bay"}
# What people type where no place is named.
NO_PLACE = {
    "", "n a", "na", "none", "null", "unknown", "tbd", "various", "here", "there", "not mentioned", "on the road", "my hometown",
    "the islands", "somewhere in the mountains", "near the river", "by the fish docks", "east gate", "station road", "old quarter",
    "upper town", "harbour side", "3rd floor", "market hall", "old town", "country", "city centre", "town", "city",
}
_CUT = re.compile(r"\s*[|,;/()\n\t]\s*|\s+-\s+|\s+[–—]\s+")


def place_form(text: str) -> tuple[str, str]:
    """The plain form of a segment without the words around the name, and its key; codes keep their letters."""
    words = plain(text).split()
    raw = " ".join(words)
    if raw in NO_PLACE:
        return raw, ""
    if words and words[0] in _SHORT_FIRST and len(words) > 1:
        words[0] = _SHORT_FIRST[words[0]]
    if len(words) > 1 and words[-1] in _SHORT_LAST:
        words[-1] = _SHORT_LAST[words[-1]]
    if len(words) > 1 and (words[0] == "rep" or within(words[0], "republic", 2) <= 2):
        words = words[2:] if len(words) > 2 and words[1] in ("of", "o", "f", "fo", "off") else words[1:]
    while len(words) > 1 and words[0] in _BEFORE:
        words = words[1:]
    while len(words) > 1 and words[-1] in _AFTER:
        words = words[:-1]
    whole = "".join(words)
    return raw, whole if len(whole) <= 3 else sound(whole)


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, *values in zip(pdf["triple"], pdf["location"], pdf["city"], pdf["country"], strict=True):
            for field, value in zip(("location", "city", "country"), values, strict=True):
                if isinstance(value, str) and plain(value) not in NO_PLACE:
                    for piece in dict.fromkeys(_CUT.split(value)):
                        raw, form = place_form(piece)
                        if raw:
                            out.append((key, field, raw, form))
        yield pd.DataFrame(out, columns=["triple", "field", "raw", "form"])


def _spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            names = [r.city] if r.kind == "city" else [r.country, r.country_code]
            alts = r.alt_names if r.alt_names is not None else []
            for name in [*names, *alts]:
                form = place_form(name)[1] if isinstance(name, str) else ""
                if form:
                    out.append((r.place_id, r.kind, r.country, form, grams(form)))
        yield pd.DataFrame(out, columns=["place_id", "kind", "of_country", "spelling", "grams"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(forms: pd.Series) -> pd.Series:
    return forms.map(grams)


@F.pandas_udf(T.IntegerType())
def _slips(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series(within_many(a.tolist(), b.tolist(), most.to_numpy()))


def similar_spellings(forms: DataFrame, spellings: DataFrame, threshold: float = MIN_JACCARD) -> DataFrame:
    """Prefix-filter join of distinct `forms` (form) with `spellings` (spelling, grams): form, spelling, jaccard.

    Exact: every pair with Jaccard >= threshold comes out. Empty forms match nothing.
    """
    listed = spellings.select("spelling", "grams").dropDuplicates(["spelling"])
    rarity = listed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, F.explode("grams").alias("gram"), F.size("grams").alias("size")).join(rarity, "gram", "left")
        order = Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "gram")
        return (
            each.withColumn("at", F.row_number().over(order))
            .where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
            .where("n is not null")
            .select(name, "gram", "size", "at")
        )

    q = materialize(forms.where("form <> ''").select("form").distinct().withColumn("grams", _grams("form")), "forms")
    left = prefixes(q, "form").withColumnsRenamed({"size": "size_a", "at": "at_a"})
    right = prefixes(listed, "spelling").withColumnsRenamed({"size": "size_b", "at": "at_b"})
    # |A n B| >= t (|A| + |B|) / (1 + t) bounds both the sizes and the tokens left after a shared position
    need = F.col("size_a").__add__(F.col("size_b")) * (threshold / (1 + threshold))
    left_over = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1
    pairs = (
        left.join(right, "gram")
        .where((F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a")))
        .groupBy("form", "spelling")
        .agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
        .where(left_over >= need)
        .select("form", "spelling")
    )
    shared = F.size(F.array_intersect("grams", "grams_b"))
    return (
        pairs.join(q, "form")
        .join(listed.withColumnRenamed("grams", "grams_b"), "spelling")
        .withColumn("jaccard", shared / (F.size("grams") + F.size("grams_b") - shared))
        .where(F.col("jaccard") >= threshold)
        .select("form", "spelling", "jaccard")
    )


def resolve_places(values: DataFrame, places: DataFrame, threshold: float = MIN_JACCARD) -> DataFrame:
    """Place of each distinct (location, city, country) of `values`.

    Returns location, city, country (as typed), place_id (0: none), status ('city', 'country', 'unlisted', 'none'),
    city_id, country_id (0: none), similarity (Jaccard of the deciding segment).
    """
    nul = F.lit("\u0000")
    triples = (
        values.select("location", "city", "country").distinct()
        .withColumn("triple", F.concat_ws("\u0001", *[F.coalesce(c, nul) for c in ("location", "city", "country")]))
    )
    # both are used several times below: written once instead of worked out again
    segments = triples.mapInPandas(_segments, "triple string, field string, raw string, form string").select("triple", "raw", "form").distinct()
    segments = materialize(segments, "segments")
    spellings = places.select("place_id", "kind", "city", "country", "country_code", "alt_names").mapInPandas(
        _spellings, "place_id long, kind string, of_country string, spelling string, grams array<string>"
    )
    spellings = materialize(spellings, "spellings")
    length = F.length("form")
    # a code must be exact; longer names may hold so many slips
    slips = F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 8, 2).otherwise(3).cast("int")
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = similar_spellings(segments, spellings, threshold).repartition(spread, "form").withColumn("slips", _slips("form", "spelling", slips)).where(F.col("slips") <= slips)
    best = Window.partitionBy("form").orderBy(F.desc("jaccard"), "slips")
    near = near.withColumn("best", F.rank().over(best)).where("best = 1")
    hits = near.join(spellings.drop("grams"), "spelling").select("form", "place_id", "kind", "of_country", "slips", "jaccard").distinct()
    hits = materialize(hits, "place-hits")
    named = segments.join(hits, "form", "left")

    generic = F.col("raw").isin(sorted(NO_PLACE))
    cities = named.where("kind = 'city'")
    # a segment that stands beside several listed cities is a spot inside a city, not a city
    spots = (
        segments.select("triple", "raw").join(cities.select("triple", "place_id", F.col("raw").alias("by")), "triple")
        .where("raw <> by").groupBy("raw").agg(F.countDistinct("place_id").alias("n")).where("n > 1").select("raw", F.lit(True).alias("spot"))
    )
    named = named.join(spots, "raw", "left")

    countries = named.where("kind = 'country'").groupBy("triple").agg(
        F.collect_set("of_country").alias("countries"),
        F.min(F.struct("slips", (-F.col("jaccard")).alias("far"), "place_id")).alias("land"),
    )
    ranked = cities.join(countries.select("triple", "countries"), "triple", "left").withColumn(
        "agrees", F.when(F.col("countries").isNull(), 1).when(F.array_contains("countries", F.col("of_country")), 0).otherwise(2)
    )
    city = ranked.groupBy("triple").agg(F.min(F.struct("agrees", "slips", (-F.col("jaccard")).alias("far"), "place_id")).alias("best"))
    other = named.where(F.col("place_id").isNull() & ~generic & F.col("spot").isNull()).select("triple").distinct().withColumn("other", F.lit(True))
    out = triples.join(city, "triple", "left").join(countries, "triple", "left").join(other, "triple", "left")
    # a city of another country than the one named isn't the listed one
    has_city = F.col("best").isNotNull() & (F.col("best.agrees") < 2)
    status = (
        F.when(has_city, "city")
        .when(F.col("best").isNotNull() | F.col("other"), "unlisted")
        .when(F.col("land").isNotNull(), "country")
        .otherwise("none")
    )
    out = out.select(
        "location", "city", "country", status.alias("status"),
        F.when(has_city, F.col("best.place_id")).otherwise(F.lit(0)).cast("long").alias("city_id"),
        F.coalesce("land.place_id", F.lit(0)).cast("long").alias("country_id"),
        F.when(has_city, -F.col("best.far")).otherwise(-F.col("land.far")).alias("similarity"),
    )
    place = F.when(F.col("status") == "city", F.col("city_id")).when(F.col("status") == "country", F.col("country_id")).otherwise(0)
    return out.withColumn("place_id", place.cast("long"))


def map_mentions(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Each mention_id once with its place_id, status and similarity; columns of the input beyond the four are ignored."""
    rows = mentions.select("mention_id", "location", "city", "country").dropDuplicates(["mention_id"])
    typed = ("location", "city", "country")
    placed = resolve_places(rows, places).withColumnsRenamed({c: f"_{c}" for c in typed})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in typed]
    return rows.join(placed, same[0] & same[1] & same[2]).drop(*[f"_{c}" for c in typed])


def found(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """p1_found: mentions with some place typed that isn't exactly a listed (city, country), with their place_id."""
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("location", "city", "country")]
    listed = places.where("kind = 'city'").select("city", "country").distinct()
    rows = mentions.where(~(blank[0] & blank[1] & blank[2])).join(listed, ["city", "country"], "left_anti")
    return map_mentions(rows, places).select("mention_id", "place_id")


def unmatched(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """Report of the typed triples that name no listed place, with the number of mentions."""
    return (
        map_mentions(mentions, places).where("place_id = 0").groupBy("location", "city", "country", "status").agg(F.count("*").alias("mentions"))
    )
