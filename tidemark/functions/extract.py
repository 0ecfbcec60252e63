"""Facts read out of free text: ratings, lead times, moods; repair of model output; tolerant field readers. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any, count_hits

# Patterns of ratings said aloud, with the top of their scale; they overlap, and each hit counts.
RATINGS = [
    (r"(\d+(?:\.\d+)?)\s*(?:out of|/)\s*10", 10),
    (r"i(?:'d| would)?\s*(?:give|rate)\s*(?:it|this)?\s*(?:a|an)?\s*(\d+(?:\.\d+)?)\s*(?:out of|/)\s*10", 10),
    (r"(\d+(?:\.\d+)?)\s*(?:out of|/)\s*5\s*(?:stars?)?", 5),
    (r"i(?:'d| would)?\s*(?:give|rate)\s*(?:it|this)?\s*(?:a|an)?\s*(\d+(?:\.\d+)?)\s*(?:out of|/)\s*5", 5),
    (r"(\d+(?:\.\d+)?)\s*stars?", 5),
    (r"\b(five|5)\s*stars?\b", 5),
    (r"\b(four|4)\s*stars?\b", 5),
    (r"\b(three|3)\s*stars?\b", 5),
]
# Words of strong and of moderate praise and blame.
STRONG_PRAISE = [
    "amazing", "incredible", "fantastic", "outstanding", "exceptional", "perfect", "breathtaking", "stunning", "magnificent", "spectacular", "must-visit",
    "must see", "best", "favorite", "favourite", "loved", "blown away", "highly recommend",
]
PRAISE = ["great", "good", "nice", "lovely", "beautiful", "enjoyed", "recommend", "worth it", "worthwhile", "pleasant", "wonderful"]
STRONG_BLAME = [
    "terrible", "awful", "horrible", "worst", "disaster", "avoid", "waste of", "disappointed", "disappointing", "overrated", "scam", "rip-off", "tourist trap",
]
BLAME = ["bad", "not great", "mediocre", "underwhelming", "crowded", "overpriced", "skip", "not worth"]
# Words that say a booking is needed.
BOOKING = ["required", "must book", "advance booking", "book ahead"]


def said_ratings(text: Column) -> Column:
    """All ratings said in a text, on a scale of 1 to 5, in order of pattern; an empty array for null."""
    low = F.lower(text)
    word = lambda x: F.when(x == "five", "5").when(x == "four", "4").when(x == "three", "3").otherwise(x)
    each = [
        F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x, top=top: F.least(F.greatest(word(x).cast("double") / top * 5, F.lit(1.0)), F.lit(5.0)))
        for p, top in RATINGS
    ]
    return F.coalesce(F.flatten(F.array(*each)), F.array().cast("array<double>"))


def mood(text: Column) -> tuple[Column, Column]:
    """Rating (1 to 5) that a text's words of praise and blame imply, and the confidence in it; 3 and 0.2 without any."""
    low = F.lower(text)
    sp, p, sb, b = (count_hits(low, words) for words in (STRONG_PRAISE, PRAISE, STRONG_BLAME, BLAME))
    n = sp + p + sb + b
    rating = F.when(n > 0, 3 + (2 * sp + p - 2 * sb - b) / n).otherwise(3.0)
    return F.least(F.greatest(rating, F.lit(1.0)), F.lit(5.0)), F.when(n > 0, F.least(F.lit(1.0), n / 5.0)).otherwise(0.2)


def needs_booking(text: Column) -> Column:
    return contains_any(F.lower(text), BOOKING)


def lead_time(text: Column) -> Column:
    """'N days ahead' (weeks, months) as first said, null if not said."""
    pattern = r"(\d+)\s*(day|week|month)"
    n, unit = (F.regexp_extract(F.lower(text), pattern, k) for k in (1, 2))
    return F.when(n != "", F.concat(n, F.lit(" "), unit, F.lit("s ahead")))


def fenced_json(text: Column) -> Column:
    """The JSON inside a fenced block, else the text from its first brace to its last; null where there is neither."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).when(bare != "", bare)


def as_list(text: Column) -> Column:
    """A comma-separated value as an array of trimmed, non-empty parts; empty for null."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def as_flag(text: Column) -> Column:
    """True and false for yes and no words, null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "y", "true", "1", "required"), True).when(low.isin("no", "n", "false", "0", "none"), False)


def as_confidence(text: Column) -> Column:
    """0.9, 0.6, 0.3 for the words high, medium, low; a number as it is within 0 to 1; 0.5 otherwise."""
    low = F.lower(F.trim(text))
    number = low.try_cast("double")
    said = F.when(low == "high", 0.9).when(low == "medium", 0.6).when(low == "low", 0.3)
    return F.coalesce(said, F.when(number.between(0.0, 1.0), number), F.lit(0.5))


def correct(text: Column, dictionary: list[tuple[str, str]]) -> Column:
    """`text` with each whole word of the dictionary replaced, in order, whatever its case."""
    return reduce(lambda t, pair: F.regexp_replace(t, rf"(?i)\b{pair[0]}\b", pair[1]), dictionary, text)


def sentences(*parts: Column) -> Column:
    """Parts as one text, a full stop between them; null and blank ones are left out."""
    return F.concat_ws(". ", *[F.when(F.length(F.trim(p)) > 0, p) for p in parts])


def text_issues(text: Column, keywords: list[str]) -> Column:
    """What keeps a text from being embedded: too short (50 words), too long (1000), placeholders (over 3), off topic (under 2 keywords)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    holes = F.size(F.regexp_extract_all(low, F.lit(r"(unknown|n/a|none)"), F.lit(1)))
    rules = {"too_short": n < 50, "too_long": n > 1000, "placeholders": holes > 3, "off_topic": count_hits(low, keywords) < 2}
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in rules.items()]))
