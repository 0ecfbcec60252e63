"""Names of establishments and people as typed: their distinctive core, their kind, and the forms the core is typed in."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

from tidemark.llm.spelling import CACHED, plain, sound, within

# Kinds of establishment and the words that people type for them.
KINDS = {
    "bus station": "bus station|bus stn|bus stat|bus terminal|station|stn|stat",
    "ferry pier": "ferry pier|ferry dock|ferry|pier|dock",
    "beach resort": "beach resort|beach rst|bch resort|bch rst|resort|rst",
    "guesthouse": "guesthouse|guest house|guesthse|guest hse|gh",
    "hotel": "hotel|htl|hotl",
    "museum": "museum|mus|musm",
    "botanical garden": "botanical garden|botanical gdn|botanical gdns|botanic garden|botanical gardens|bot garden|bot gdn|garden|gardens|gdn|gdns",
    "bazaar": "bazaar|bazar|bzr",
    "night market": "night market|night mkt|nite market|n market|nite mkt|n mkt|market|mkt",
    "viewpoint": "viewpoint|view point|view pt|vwpt|viewpt|vw pt",
    "cooking school": "cooking school|cookery school|cooking sch|cookery sch|cook school|school|sch",
    "waterfall": "waterfall|waterfalls|wfall|falls|water fall",
    "restaurant": "restaurant|restrnt|resto|rest|restarant",
    "temple": "temple|tpl|tmpl",
    "cafe": "cafe|coffee|coffee house|coffee shop|caf",
    "dive center": "dive center|dive ctr|diving center|dive centre|diving ctr|diving centre|diving",
    "palace": "palace|plc|pal",
    "noodle house": "noodle house|noodles|noodle hse|noodle|noodle shop",
    "kitchen": "kitchen|ktchn|kitch",
}
_PHRASES = sorted(((p.split(), kind) for kind, forms in KINDS.items() for p in forms.split("|")), key=lambda x: -len(" ".join(x[0])))
_GLUED = sorted(((kind.replace(" ", ""), kind) for kind in KINDS), key=lambda x: -len(x[0]))

# Words people put before a name, and short forms of first names.
TITLES = {"mx", "mr", "mrs", "ms", "guide"}
NOISE = set("the old famous visit best our guide mx mr mrs ms dr this some a an local random new my".split())
NICKNAMES = {
    "margaret": "maggie peg peggy meg", "isabella": "bella izzy isa", "michael": "mike mick mickey", "josephine": "jo josie",
    "nicholas": "nick nico", "dorothea": "thea dora dorothy", "francisco": "fran paco pancho", "samantha": "sam sammy",
    "katherine": "kathy kate katie kat", "alexander": "alex sasha", "william": "will bill billy", "theodore": "theo ted teddy",
    "robert": "bob rob bobby", "giuseppe": "beppe peppe", "elizabeth": "liz beth lizzie eliza", "thomas": "tom tommy",
    "richard": "rick dick", "edward": "ed eddie", "catherine": "cathy kate", "anthony": "tony", "joseph": "joe", "james": "jim jimmy",
}
FULL_NAMES = {nick: full for full, nicks in NICKNAMES.items() for nick in nicks.split()}
# Names that stand for no particular place.
GENERIC = {"street food stall", "airbnb", "place", "beach", "bus", "guide", "unknown", "stall", "street food", "food stall", "n a", "na", "none", "tbd", "hostel", "taxi"}

_AWAY = re.compile(r"\s*\(again\)\s*|\s+vlog\s*$", re.IGNORECASE)
_AT = re.compile(r"\s+@\s*(.+)$|\s+in\s+(\S.*)$|\s+-\s+(\S.*)$", re.IGNORECASE)
_INITIAL = re.compile(r"\s*a\.", re.IGNORECASE)
_SYLLABLES = re.compile(r"(?:[^aeiou]*[aeiou](?:[^aeiou](?![aeiou]))?){3}")


class Name(NamedTuple):
    core: tuple[str, ...]  # plain words of the core
    kind: str  # '' if no kind is named
    at: str  # a place named behind the name, '' if none
    person: bool


def _close(word: str, form: str, least: int) -> bool:
    if word == form:
        return True
    k = 1 if len(form) < 7 else 2
    if len(form) == least == 4 and word[:1] != form[:1]:
        return False
    return len(form) >= least and abs(len(word) - len(form)) <= k and within(word, form, k) <= k


_ORDER = {" ".join(phrase): k for k, (phrase, _) in reversed(list(enumerate(_PHRASES)))}
_BY_PLACE = [{size: sorted({p[at] for p, _ in _PHRASES if len(p) == size}) for size in (1, 2)} if not at else {2: sorted({p[1] for p, _ in _PHRASES if len(p) == 2})} for at in (0, 1)]


@lru_cache(maxsize=CACHED)
def _near_forms(word: str, at: int, size: int) -> frozenset[str]:
    """The words that stand at a place of a kind's phrase of this size and that `word` is a spelling of."""
    least = 3 if size > 1 else 4
    return frozenset(form for form in _BY_PLACE[at][size] if _close(word, form, least))


def _kind_at(words: list[str]) -> tuple[int, int, str] | None:
    """(from, to, kind) of the kind's phrase in the words: more words before fewer, exact before close, ends before the middle."""
    n = len(words)
    for size in (2, 1):
        if size > n:
            continue
        starts = list(dict.fromkeys([n - size, 0, *range(n - size, -1, -1)]))
        for exact in (True, False):
            found = []
            for rank, at in enumerate(starts):
                part = words[at : at + size]
                if exact:
                    said = [" ".join(part)]
                elif size == 1:
                    said = list(_near_forms(part[0], 0, 1))
                else:
                    said = [f"{x} {y}" for x in _near_forms(part[0], 0, 2) for y in _near_forms(part[1], 1, 2)]
                found += [(_ORDER[p], rank, at) for p in said if p in _ORDER and p.count(" ") == size - 1]
            if found:
                order, _, at = min(found)
                return at, at + size, _PHRASES[order][1]
    return None


@lru_cache(maxsize=CACHED)
def parse(name: str | None) -> Name:
    """The parts of a typed name; an empty core for null, blank and generic names."""
    if not name:
        return Name((), "", "", False)
    text = _AWAY.sub(" ", name.replace("_", " ")).strip()
    at = ""
    if m := _AT.search(text):
        at = next(g for g in m.groups() if g)
        text = text[: m.start()]
    text = re.sub(r"(?<=\w)-(?=\w)", "", text.replace("'", ""))
    words = plain(text).split()
    title = bool(words) and (words[0] in TITLES or words[:2] == ["our", "guide"])
    while len(words) > 1 and words[0] in NOISE and not (words[0] == "a" and _INITIAL.match(text)):
        words = words[1:]
    if not words or " ".join(words) in GENERIC:
        return Name((), "", at, False)
    found = _kind_at(words)
    if found:
        a, b, kind = found
        before, after = words[:a], words[b:]
        # words behind a kind that stands last in a name are a place, those behind one that stands first are the core
        if before and after:
            at = at or " ".join(after)
            after = []
        core = before or after
        return Name(tuple(w for w in core if w not in NOISE), kind, at, False)
    glued = "".join(words)
    for suffix, kind in _GLUED:
        if len(glued) > len(suffix) + 3 and glued.endswith(suffix):
            return Name((glued[: -len(suffix)],), kind, at, False)
    person = len(words) == 2 and ("," in text or words[0] in NICKNAMES or words[0] in FULL_NAMES or min(map(len, words)) == 1)
    return Name(tuple(words), "", at, title or person or _first_name(words))


def _first_name(words: list[str]) -> bool:
    return 1 < len(words) <= 3 and any(within(w, f, 2) <= 2 for w in words for f in NICKNAMES if len(f) > 5)


def first_name(word: str) -> str:
    """The full first name a word stands for, else the word."""
    if word in NICKNAMES:
        return word
    if word in FULL_NAMES:
        return FULL_NAMES[word]
    close = [f for f in NICKNAMES if len(f) > 5 and within(word, f, 2) <= 2]
    return close[0] if len(close) == 1 else word


def short_form(core: str) -> str:
    """The first three syllables, by which people call a place for short."""
    m = _SYLLABLES.match(core)
    return m.group() if m else core


def without_city(name: str | None, *places: str | None) -> str | None:
    """`name` without the name of one of the `places` where it ends with one."""
    if not name:
        return name
    words = name.split()
    folded = [sound(plain(w)) for w in words]
    for place in places:
        key = sound(plain(re.split(r"[,;/|(]", place)[0])) if place else ""
        for k in range(1, min(4, len(words))):
            if len(key) >= 4 and "".join(folded[-k:]) == key:
                return " ".join(words[:-k])
    return name


def index_forms(name: Name) -> list[tuple[str, str]]:
    """(form, string) under which a known name is found: full, short, and for people the surname with the first letter."""
    if not name.core:
        return []
    words = list(name.core)
    if name.person and len(words) == 2:
        first = first_name(words[0])
        return [("full", sound(first + words[1])), ("last " + first[0], sound(words[1])), ("surname", sound(words[1]))]
    glued = sound("".join(words))
    out = [("full", glued)]
    short = sound(short_form("".join(words)))
    if 5 <= len(short) < len(glued):
        out.append(("short", short))
    return out


def query_forms(name: Name) -> list[tuple[str, str]]:
    """(form, string) by which a typed name is looked up, for every order of its words."""
    words = list(name.core)
    if not words or len("".join(words)) < 3:
        return []
    out = [("full", sound("".join(words)))]
    short = sound(short_form("".join(words)))
    if not name.person and 5 <= len(short) < len(out[0][1]):
        out.append(("short", short))
    if name.person and len(words) == 1:
        out.append(("surname", sound(words[0])))
    if 2 <= len(words) <= 3:
        for order in permutations(words):
            out.append(("full", sound("".join(order))))
            if len(order) == 2:
                if len(order[0]) == 1:
                    out.append(("last " + order[0], sound(order[1])))
                else:
                    full = first_name(order[0])
                    if full != order[0]:
                        out.append(("full", sound(full + order[1])))
    return list(dict.fromkeys(o for o in out if len(o[1]) >= 3))


def slips_allowed(length: int) -> int:
    """Edit distance up to which strings of this length are spellings of one name."""
    return 0 if length <= 4 else 1 if length <= 6 else 2 if length <= 9 else 3
