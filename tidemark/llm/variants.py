"""Problem 5: variant spellings of names typed by people, linked to the canonical entity they refer to.

Method: trie join. The distinct cores of all known names and aliases are sharded into tries, the distinct cores typed
(for each order of their words, nicknames written out) run as Levenshtein automata over the tries, and the pairs found
are checked for kind, first letter, and place. One entity must come out ahead; a name that fits several is not linked.

Defined results: null, blank and generic names ("the viewpoint") link to nothing; a mention that names another listed
city than the entity's, or an unlisted one, is another establishment; without any place the name alone decides; repeated
mention_ids count once; empty tables give no links. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.names import index_forms, parse, query_forms, without_city
from tidemark.llm.places import resolve_places
from tidemark.llm.tries import trie_join
from tidemark.session import materialize


def _known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["entity_id", "form", "known", "kind", "rank"]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            main = parse(r.name)
            for rank, name in enumerate([r.name, *(r.aliases if r.aliases is not None else [])]):
                parts = parse(name)
                for form, text in index_forms(parts):
                    # an alias of another core than the main name can't give it a short form of its own
                    if text and (rank == 0 or form == "full"):
                        out.append((r.entity_id, form, text, main.kind or parts.kind, min(rank, 1)))
        yield pd.DataFrame(out, columns=names).drop_duplicates()


def known_forms(entities: DataFrame) -> DataFrame:
    """Index rows of entities (entity_id bigint, name, aliases): entity_id, form, known, kind, rank (0: main name)."""
    return entities.select("entity_id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).mapInPandas(
        _known, "entity_id long, form string, known string, kind string, rank int"
    )


def _typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name in pdf["name"]:
            parts = parse(name)
            for k, (form, text) in enumerate(query_forms(parts)):
                out.append((name, form, text, parts.kind, k))
        yield pd.DataFrame(out, columns=["name", "form", "query", "kind", "turn"])


def typed_forms(names: DataFrame) -> DataFrame:
    """Look-up rows of distinct typed names (name): name, form, query, kind, turn (0: as typed)."""
    return names.select("name").where("name is not null").distinct().mapInPandas(_typed, "name string, form string, query string, kind string, turn int")


@F.pandas_udf(T.StructType([T.StructField("behind", T.StringType()), T.StructField("bare", T.StringType())]))
def _name_parts(names: pd.Series, cities: pd.Series, locations: pd.Series) -> pd.DataFrame:
    """The place named behind a name (null without one), and the name without the row's own city or location at its end."""
    return pd.DataFrame({
        "behind": pd.Series([parse(n).at or None for n in names], dtype="object"),
        "bare": pd.Series([without_city(n, c, x) for n, c, x in zip(names, cities, locations, strict=True)], dtype="object"),
    })


def with_place(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """`rows` (location, city, country and the typed `name`) with city_id, country_id, place_status, and the bare name.

    A place named behind the name counts where no other value names one; it is the location then. The name comes out
    without the row's own city or location at its end. The rows are written once, since they are used several times.
    """
    rows = rows.withColumn("_parts", _name_parts(F.col(name), F.col("city"), F.col("location")))
    place = F.coalesce(F.when(F.trim("location") != "", F.col("location")), F.col("_parts.behind"))
    rows = materialize(rows.withColumns({"location": place, name: F.col("_parts.bare")}).drop("_parts"), "named")
    values = rows.select("location", "city", "country").distinct()
    placed = resolve_places(values, places).select(
        F.col("location").alias("_l2"), F.col("city").alias("_c2"), F.col("country").alias("_k2"), "city_id", "country_id", F.col("status").alias("place_status")
    )
    same = F.col("location").eqNullSafe(F.col("_l2")) & F.col("city").eqNullSafe(F.col("_c2")) & F.col("country").eqNullSafe(F.col("_k2"))
    return rows.join(placed, same, "left").drop("_l2", "_c2", "_k2").fillna({"place_status": "none", "city_id": 0, "country_id": 0})


def listed_city(entities: DataFrame, places: DataFrame) -> DataFrame:
    """entity_id with the city_id and country_id of its exactly spelled city and country (0 where not listed)."""
    city = places.where("kind = 'city'").groupBy("city", "country").agg(F.min("place_id").alias("city_id"))
    land = places.where("kind = 'country'").groupBy("country").agg(F.min("place_id").alias("country_id"))
    return entities.select("entity_id", "city", "country").join(city, ["city", "country"], "left").join(land, "country", "left").select(
        "entity_id", F.coalesce("city_id", F.lit(0)).alias("e_city"), F.coalesce("country_id", F.lit(0)).alias("e_country")
    )


def name_candidates(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of a typed name and an entity it may be a spelling of: name, entity_id, cost (0: exact), slips, same_kind, kind."""
    known, typed = known_forms(entities), typed_forms(names)
    known = materialize(known, "known-forms")
    typed = materialize(typed, "typed-forms")
    pairs = trie_join(typed.select("query"), known.select("known"))
    pairs = materialize(pairs, "trie-pairs")
    q = typed.join(pairs, "query")
    k = known.withColumnsRenamed({"form": "k_form", "kind": "k_kind"})
    size = F.length("query")
    # a short form or surname stands for a name only if nearly exact, and isn't one itself of a full core typed with it
    fits = (
        ((F.col("form") == "full") & (F.col("k_form") == "full"))
        | ((F.col("form") == "full") & (F.col("k_form") == "short") & (F.col("slips") <= F.when(size >= 7, 1).otherwise(0)))
        | ((F.col("form") == F.col("k_form")) & F.col("form").startswith("last"))
        | ((F.col("form") == "surname") & (F.col("k_form") == "surname"))
    )
    kinds = (F.col("kind") == "") | (F.col("k_kind") == "") | (F.col("kind") == F.col("k_kind"))
    cost = (
        F.col("slips") * 2
        + F.when(F.col("k_form") == "short", 3).when(F.col("k_form") != "full", 2).otherwise(0)
        + F.when((F.col("kind") != "") & (F.col("kind") == F.col("k_kind")), 0).otherwise(1)
        + F.when(F.col("turn") > 0, 1).otherwise(0)
        + F.col("rank")
    )
    same = (F.col("kind") == F.col("k_kind")).alias("same_kind")
    best = F.min(F.struct(cost.alias("cost"), "slips", same)).alias("b")
    return q.join(k, "known").where(fits & kinds).groupBy("name", "entity_id").agg(best, F.max("kind").alias("kind")).select("name", "entity_id", "b.*", "kind")


def link(mentions: DataFrame, entities: DataFrame, places: DataFrame) -> DataFrame:
    """Each mention (id, name, entity_type, location, city, country) with the entity it refers to: id, entity_id, cost.

    `entities` has entity_id, name, aliases, entity_type, city, country.
    """
    # mentions with equal values get equal results: link the distinct ones
    values = ["name", "entity_type", "location", "city", "country"]
    distinct = mentions.select(*values).distinct()
    key = F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in values])
    distinct = with_place(distinct.withColumn("key", key), places, "name")
    distinct = materialize(distinct, "placed-names")
    candidates = name_candidates(distinct.select("name"), entities)
    facts = listed_city(entities, places).join(entities.select("entity_id", F.col("entity_type").alias("e_type")), "entity_id")
    pairs = distinct.join(candidates, "name").join(facts, "entity_id")
    in_city = (F.col("city_id") > 0) & (F.col("city_id") == F.col("e_city"))
    other_city = (F.col("place_status") == "unlisted") | ((F.col("city_id") > 0) & (F.col("city_id") != F.col("e_city")))
    other_land = (F.col("country_id") > 0) & (F.col("e_country") > 0) & (F.col("country_id") != F.col("e_country")) & (F.col("city_id") == 0)
    other_type = (F.col("kind") == "") & F.col("entity_type").isNotNull() & ~F.col("entity_type").isin("unknown", "") & (F.col("entity_type") != F.col("e_type"))
    pairs = pairs.where(~other_city & ~other_land & ~other_type)
    # three slips are one name only where city and kind say so too
    pairs = pairs.where((F.col("slips") <= 2) | (in_city & F.col("same_kind")))
    pairs = pairs.withColumn("cost", F.col("cost") - F.when(in_city, 1).otherwise(0))
    best = Window.partitionBy("key").orderBy("cost", "entity_id")
    top = pairs.withColumns({"at": F.row_number().over(best), "next": F.lead("cost").over(best)}).where("at = 1")
    top = top.where(F.col("next").isNull() | (F.col("next") > F.col("cost"))).select("key", "entity_id", "cost")
    return mentions.withColumn("key", key).join(top, "key").drop("key")


def entities_of(canonical: DataFrame) -> DataFrame:
    return canonical.dropDuplicates(["entity_no"]).select(
        F.col("entity_no").alias("entity_id"), F.col("canonical_name").alias("name"), "aliases", "entity_type", "city", "country"
    )


def linked_mentions(mentions: DataFrame, canonical: DataFrame, places: DataFrame) -> DataFrame:
    """Each mention_id of extracted_entities that refers to a canonical entity: mention_id, name, entity_no, cost."""
    rows = mentions.dropDuplicates(["mention_id"]).select("mention_id", F.col("entity_name").alias("name"), "entity_type", "location", "city", "country")
    return link(rows, entities_of(canonical), places).select("mention_id", "name", F.col("entity_id").alias("entity_no"), "cost")


def found(mentions: DataFrame, canonical: DataFrame, places: DataFrame) -> DataFrame:
    """p5_found: linked mentions whose name is neither the canonical name nor an alias, character for character."""
    links = linked_mentions(mentions, canonical, places)
    names = canonical.select("entity_no", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name"))).alias("name"))
    return links.join(names.distinct(), ["entity_no", "name"], "left_anti").select("mention_id", "entity_no")
