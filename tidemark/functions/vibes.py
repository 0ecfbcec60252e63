"""Twelve moods of a place, from its kind, its price and the words said of it, and how well two of them fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import count_hits
from tidemark.functions.vector import cosine

# The moods in order, and the words that speak for each.
WORDS = {
    "adventure": ["hiking", "trekking", "climb", "extreme", "adventure", "thrill", "zipline", "diving", "snorkel", "surf", "kayak", "rafting", "mountain", "trek", "explore", "wild", "adrenaline"],
    "relaxation": ["relax", "spa", "massage", "beach", "chill", "peaceful", "calm", "tranquil", "serene", "quiet", "laid-back", "zen", "unwind", "lounge", "slow", "gentle"],
    "culture": ["temple", "museum", "palace", "historic", "cultural", "art", "gallery", "architecture", "traditional", "heritage", "ancient", "monument", "cultural", "religious", "spiritual", "shrine"],
    "nightlife": ["nightlife", "party", "club", "bar", "pub", "night", "dance", "dj", "music", "entertainment", "live music", "rooftop bar", "cocktail", "disco", "nightclub", "late night"],
    "nature": ["nature", "park", "garden", "forest", "jungle", "wildlife", "bird", "animal", "eco", "green", "tree", "waterfall", "scenic", "natural", "outdoors", "landscape"],
    "food": ["food", "restaurant", "street food", "market", "cuisine", "delicious", "tasty", "eat", "dining", "chef", "dish", "local food", "foodie", "culinary", "flavor", "meal"],
    "shopping": ["shopping", "market", "mall", "shop", "store", "boutique", "souvenir", "craft", "buy", "bargain", "vendor", "retail", "market", "bazaar", "goods"],
    "luxury": ["luxury", "premium", "high-end", "exclusive", "upscale", "five-star", "elegant", "sophisticated", "lavish", "posh", "deluxe", "VIP", "expensive", "finest"],
    "budget": ["budget", "cheap", "affordable", "free", "inexpensive", "value", "economical", "backpack", "low-cost", "bargain", "wallet-friendly", "cost-effective"],
    "social": ["social", "group", "meet", "people", "friendly", "fun", "lively", "bustling", "crowded", "popular", "vibrant", "energetic", "atmosphere", "interactive"],
    "solo": ["solo", "alone", "independent", "self", "individual", "peaceful", "quiet", "introspective", "meditative", "personal", "private"],
    "family": ["family", "kid", "children", "child-friendly", "kids", "toddler", "baby", "playground", "educational", "safe", "wholesome", "all-ages"],
}
# Moods of a kind of place, and of a price level.
OF_KIND = {
    "attraction": {"culture": 0.7, "nature": 0.3}, "restaurant": {"food": 1.0, "social": 0.4}, "hotel": {"relaxation": 0.5},
    "activity": {"adventure": 0.6, "social": 0.5}, "shopping": {"shopping": 1.0, "culture": 0.2}, "transportation": {"budget": 0.3},
}
OF_PRICE = {"$": (0.8, 0.1), "$$": (0.8, 0.1), "$$$": (0.3, 0.5), "$$$$": (0.1, 0.9)}  # budget, luxury
MOODS = list(WORDS)


def said(text: Column, mood: str, share: float) -> Column:
    """How strongly a text speaks for a mood: the words of the mood it holds, full at `share` of them."""
    words = WORDS[mood]
    return F.least(F.lit(1.0), count_hits(F.lower(F.coalesce(text, F.lit(""))), words) / (share * len(words)))


def of_entity(kind: Column, price: Column, text: Column) -> Column:
    """The moods of a place as an array: the larger of kind and price, blended 0.4 to 0.6 with what is said where anything is."""
    out = []
    for mood in MOODS:
        base = F.lit(0.0)
        for k, moods in OF_KIND.items():
            if mood in moods:
                base = F.greatest(base, F.when(kind == k, moods[mood]).otherwise(0.0))
        if mood in ("budget", "luxury"):
            for level, pair in OF_PRICE.items():
                base = F.greatest(base, F.when(price == level, pair[mood == "luxury"]).otherwise(0.0))
        words = said(text, mood, 0.3)
        out.append(F.when(words > 0, 0.4 * base + 0.6 * words).otherwise(base))
    return F.array(*out)


def of_query(text: Column) -> Column:
    return F.array(*[said(text, mood, 0.2) for mood in MOODS])


def fit(a: Column, b: Column) -> Column:
    """Cosine of two mood vectors, 0 where one has none."""
    return cosine(a, b)


def mismatches(a: Column, b: Column) -> Column:
    """The moods in which two vectors are more than 0.5 apart."""
    names = F.array(*[F.lit(m) for m in MOODS])
    far = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), names, lambda gap, name: F.when(gap > 0.5, name))
    return F.array_compact(far)
