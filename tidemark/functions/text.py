"""Text expressions: normal forms, signatures, identifiers, lexicon counts. All JVM-side."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters that NFKD leaves of them.
_FOLDED = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and unicodedata.decomposition(c)}
MARKED, PLAIN = ("".join(x) for x in zip(*((c, p) for c, p in _FOLDED.items() if "a" <= p <= "z" and all(map(unicodedata.combining, unicodedata.normalize("NFKD", c)[1:]))), strict=True))


def fold_marks(c: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_entity_text(c: Column) -> Column:
    """Folded lower case of letters, digits, spaces, hyphens and apostrophes; '' for null."""
    return F.coalesce(squeeze(F.regexp_replace(fold_marks(c), r"[^a-z0-9\s\-']", "")), F.lit(""))


def normalize_location(c: Column) -> Column:
    """normalize_entity_text after commas, full stops and hyphens have become spaces."""
    return normalize_entity_text(F.regexp_replace(c, r"[,.\-]", " "))


def normalize_name(c: Column) -> Column:
    """Lower case without punctuation and without the articles the, a, an, which are taken off one after another."""
    out = squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", ""))
    return reduce(lambda x, article: F.regexp_replace(x, f"^{article} ", ""), ("the", "a", "an"), out)


def signature(*parts: Column) -> Column:
    """Normalised parts joined by a double bar; null parts count as ''."""
    return F.concat_ws("||", *[F.coalesce(F.trim(F.lower(p)), F.lit("")) for p in parts])


def city_key(c: Column) -> Column:
    """At most 15 letters and digits of a city's name."""
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), 1, 15)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def count_hits(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [F.when(c.contains(w), 1).otherwise(0) for w in words])


def truncate(c: Column, n: int) -> Column:
    """Text cut to n characters, the last three being dots where it was longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def words(c: Column) -> Column:
    """Words of three or more letters in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{3,}"), F.lit(0))


def url_hash(c: Column) -> Column:
    """Eight hex digits of a URL without query, fragment, case and closing slash."""
    base = F.regexp_replace(F.regexp_replace(F.lower(c), r"[?#].*$", ""), r"/+$", "")
    return F.substring(F.md5(base), 1, 8)


def video_id(c: Column) -> Column:
    """The 11-character id in a watch, short, embed or mobile URL, '' if there is none."""
    return F.regexp_extract(c, r"(?:v=|youtu\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})", 1)
