"""Problem 9: abusive, hateful and sexual language: a severity per document and category, and rates per source.

Method: cumulative-link ordinal regression. The reviews of a document give it a grade per category (0: no vote, 1:
some, 2: all). Weights over sparse text features (words, word pairs, word-list groups and their pairs, all after undoing
disguises) are shared by both thresholds; a document's expected severity is the sum of its probabilities of reaching
grade 1 and grade 2, from 0 to 2. A text is graded by its worst passage, so training labels the passage that the model
of the round before finds worst in a reviewed text and takes all passages of unobjectionable texts as grade 0.

Defined results: null, empty and blank texts have severity 0; texts of any length are read whole, in passages; repeated
doc_ids are scored once (least text first); reviews of unknown documents are ignored; without reviews the prior weights
of the word lists stand. The model is fitted on a bounded sample of reviewed documents (MAX_REVIEWED, by hash).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lexicon import GROUPS_OF_WORDS, LOOKALIKES, SIGNS

CATEGORIES = ("abusive", "hateful", "sexual")
#: Reviewed documents the model is fitted on, at most.
MAX_REVIEWED = 20_000
#: Words of a passage, and how far the next one starts.
PASSAGE, STEP = 18, 9
#: Expected severity from which a document counts as a case.
CASE = 0.8

_HIDDEN = re.compile("[­᠎​-‏⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ _.\-]){2,}[^\W\d_](?![^\W_])")
_END = re.compile(r"(?<=[.!?।…])\s+|\n+|\s(?=@\w)|[\U0001F300-\U0001FAFF☀-➿]+")
_TOKEN = re.compile("[\\wऀ-ॣ฀-๿@$*'’|!-]+")
_DOUBLE = re.compile(r"(.)\1+")
_LEET = re.compile(r"[a-z]", re.IGNORECASE)


@lru_cache(maxsize=300_000)
def canonical(word: str) -> str:
    """One form of a word for its disguises: case, accents, letters put for others, doubled letters."""
    word = unicodedata.normalize("NFD", word.casefold())
    word = "".join(c for c in word if not ("̀" <= c <= "ͯ")).replace("’", "'")
    if any("Ͱ" <= c <= "ӿ" or c == "ԁ" for c in word):
        word = word.translate(LOOKALIKES)
    word = word.strip("!|-'")
    if _LEET.search(word) and any(c in "@$013457!|8" for c in word):
        word = word.translate(SIGNS)
    return _DOUBLE.sub(r"\1", word.replace("l", "i").strip("'"))


def _groups() -> dict[str, set[str]]:
    return {name: {canonical(w) for w in words.split()} for name, words in GROUPS_OF_WORDS.items()}


GROUP_WORDS = _groups()
ALL_WORDS = frozenset(w for g in GROUP_WORDS.values() for w in g)
_STARS: dict[str, str] = {}
for _set in GROUP_WORDS.values():
    for _w in sorted(_set):
        if len(_w) >= 3 and _w.isascii():
            for _k in range(1, len(_w)):
                _STARS.setdefault(_w[:_k] + "*" + _w[_k + 1 :], _w)

# Endings of words for people of a country, as the corpus builds them.
_PEOPLE = re.compile(r"(?:anis|ans|ians|enns|onns|ins|uns|anders|ains|ins|ers|inns|ens|ns)$")


def _joined(match: re.Match) -> str:
    """The word that spaced letters spell; a single letter before a known word is a word of its own."""
    word = re.sub(r"[ _.\-]", "", match.group())
    return f"{word[0]} {word[1:]}" if canonical(word[1:]) in ALL_WORDS and canonical(word) not in ALL_WORDS else word


def passages(text: str) -> Iterator[list[str]]:
    """Passages of canonical words: sentences, long ones in overlapping windows; a capitalised word inside is '<Name>'."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = _SPACED.sub(_joined, text)
    for sentence in _END.split(text):
        words = []
        for k, token in enumerate(_TOKEN.findall(sentence)):
            if token[:1] in "@" and len(token) > 1 and token[1:2].isupper():
                continue
            plain = canonical(token)
            if "*" in plain:
                plain = _STARS.get(plain, plain.replace("*", ""))
            if not plain:
                continue
            if plain.isdigit():
                plain = "0"
            elif k and token[:1].isupper() and not token.isupper() and plain not in ALL_WORDS:
                plain = "<People>" if _PEOPLE.search(token) and token[:-3].isalpha() and len(token) > 6 else "<Name>"
            elif k == 0 and token[:1].isupper() and not token.isupper() and len(token) > 8 and _PEOPLE.search(token):
                plain = "<People>"
            words.append(plain)
        if len(words) <= PASSAGE + 6:
            if words:
                yield words
        else:
            for at in range(0, len(words) - STEP, STEP):
                yield words[at : at + PASSAGE]


def features(words: list[str]) -> list[str]:
    """Distinct features of a passage."""
    out = {"w " + w for w in words if w not in ("<Name>", "0")}
    out |= {f"b {a} {b}" for a, b in zip(words, words[1:], strict=False)}
    has = [name for name, group in GROUP_WORDS.items() if any(w in group for w in words)]
    if "<People>" in words and "group" not in has:
        has.append("people")
    out |= {"g " + name for name in has}
    out |= {f"p {a} {b}" for i, a in enumerate(has) for b in has[i + 1 :]}
    return sorted(out)


# What the word lists say before any review is seen (means of the weights' prior).
PRIOR = {
    "abusive": {"g insult": 1.5, "g threat": 0.8, "p insult address": 2.5, "p insult threat": 1.5, "p threat address": 1.5, "g sexual": -1.0},
    "hateful": {"g dehumanise": 1.2, "p dehumanise people": 3.0, "p expel people": 3.0, "p dehumanise group": 3.0, "p expel group": 2.5, "p dehumanise expel": 2.5},
    "sexual": {"g sexual": 5.0, "g suggest": 1.0, "p sexual suggest": 1.5, "p suggest address": 1.0},
}


class Severity:
    """Weights and thresholds per category; `score` gives the expected severities of a text."""

    def __init__(self, weights: dict[str, dict[str, float]], thresholds: dict[str, tuple[float, float]]):
        self.thresholds = thresholds
        self.names = [c for c in CATEGORIES if c in weights]
        table: dict[str, list[float]] = {}
        for k, c in enumerate(self.names):
            for f, w in weights[c].items():
                if w:
                    table.setdefault(f, [0.0] * len(self.names))[k] = w
        self.table = {f: np.array(v) for f, v in table.items()}
        # words that the table or the lists know, for a quick look at a passage
        self.known = {f[2:] for f in self.table if f[:2] == "w "} | {w for g in GROUP_WORDS.values() for w in g}
        self.pairs = {f[2:].split(" ")[0] for f in self.table if f[:2] == "b "}

    def worst(self, text: str | None) -> list[tuple[float, list[str] | None]]:
        """For each category the highest expected severity of a passage, and the passage."""
        best: list[tuple[float, list[str] | None]] = [(0.0, None)] * len(self.names)
        if not isinstance(text, str) or not text.strip():
            return best
        low = np.array([self.thresholds[c] for c in self.names])
        for words in passages(text):
            if not any(w in self.known or w in self.pairs for w in words):
                continue
            total = np.zeros(len(self.names))
            for f in features(words):
                w = self.table.get(f)
                if w is not None:
                    total = total + w
            value = (1 / (1 + np.exp(np.clip(low - total[:, None], -30, 30)))).sum(axis=1)
            for k in range(len(self.names)):
                if value[k] > best[k][0]:
                    best[k] = (float(value[k]), words)
        return best


def _solve(rows: list[list[int]], grade: np.ndarray, weight: np.ndarray, prior: np.ndarray, steps: int = 200) -> tuple[np.ndarray, tuple[float, float]]:
    """Maximum a posteriori weights and thresholds of the cumulative-link model, by Adam."""
    n, m = len(rows), len(prior)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    w, low = prior.copy(), np.array([2.0, 0.5])  # low[0] is the first threshold, low[1] the log of the gap
    reached = np.stack([grade >= 1, grade >= 2], axis=1).astype(float)
    m1, v1 = np.zeros(m + 2), np.zeros(m + 2)
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=w[cols], minlength=n)
        theta = np.array([low[0], low[0] + np.exp(low[1])])
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -30, 30)))
        p1, p2 = p[:, 0], p[:, 1]
        # likelihood of grades 0, 1, 2: 1 - p1, p1 - p2, p2
        d1 = np.where(grade == 0, -p1, np.where(grade == 1, p1 * (1 - p1) / np.maximum(p1 - p2, 1e-6), 0.0))
        d2 = np.where(grade == 2, 1 - p2, np.where(grade == 1, -p2 * (1 - p2) / np.maximum(p1 - p2, 1e-6), 0.0))
        d1, d2 = d1 * weight, d2 * weight
        dz = d1 + d2
        gw = np.bincount(cols, weights=dz[at], minlength=m) - (w - prior) * 0.6
        g = np.concatenate([gw, [-dz.sum() - (low[0] - 3.0), -d2.sum() * np.exp(low[1]) - (low[1] + 0.5)]])
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g
        move = 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-8)
        w, low = w + move[:m], np.clip(low + move[m:], [1.5, -2.0], [6.0, 1.0])
    return w, (float(low[0]), float(low[0] + np.exp(low[1])))


def grades(votes: Counter, category: str) -> int | None:
    """Grade of a reviewed text; None where another category was voted (a review names only one)."""
    total, own = sum(votes.values()), votes.get(category, 0)
    if own == total:
        return 2
    if own:
        return 1
    return 0 if votes.get("none", 0) == total else None


def fit(reviewed: list[tuple[str, Counter]], rounds: int = 3) -> Severity:
    """Model from (text, votes by category) pairs."""
    start = {c: (3.0, 3.6) for c in CATEGORIES}
    model = Severity(PRIOR, start)
    if not reviewed:
        return model
    merged: dict[str, Counter] = {}
    for text, votes in reviewed:  # reposts are one text
        key = " ".join(w for p in passages(text) for w in p)
        if key:
            merged.setdefault(key, Counter()).update(votes)
            merged[key]["\0text"] = text  # type: ignore[assignment]
    texts = []
    for votes in merged.values():
        text = votes.pop("\0text")
        texts.append((text, [features(p) for p in passages(text)], votes))
    nothing = np.zeros(len(CATEGORIES))
    weights: dict[str, dict[str, float]] = {}
    low: dict[str, tuple[float, float]] = {}
    for _ in range(rounds):
        picked: dict[str, list[tuple[list[str], int]]] = {c: [] for c in CATEGORIES}
        clean: dict[str, list[tuple[list[str], int]]] = {c: [] for c in CATEGORIES}
        for _, fs, votes in texts:
            if not fs:
                continue
            totals = [sum((model.table[x] for x in f if x in model.table), nothing) for f in fs]
            for c in CATEGORIES:
                k, g = model.names.index(c), grades(votes, c)
                if g == 0:
                    clean[c] += [(f, 0) for f in fs]
                elif g:
                    # a review names one category: the passage that is worst for it and not better explained by another
                    lead = [t[k] - 0.7 * max(0.0, *np.delete(t, k)) for t in totals]
                    # a text that another category explains and this one doesn't has a wrong review
                    if max(t[k] for t in totals) > 0.5 or all(t.max() < 2 for t in totals):
                        picked[c].append((fs[int(np.argmax(lead))], g))
        for c in CATEGORIES:
            # a passage picked for another category that no word list ties to this one is a case of that one only
            others = [(f, 0) for o in CATEGORIES if o != c for f, _ in picked[o] if sum(PRIOR[c].get(x, 0.0) for x in f) <= 0.5]
            chosen = picked[c] + clean[c] + others
            inside: Counter = Counter()
            outside: Counter = Counter()
            for f, g in chosen:
                (inside if g else outside).update(f)
            # a feature needs to be at home in cases; the word lists always take part
            keep = sorted(f for f, n in inside.items() if n >= 2 and n >= 0.25 * outside[f]) + [f for f in PRIOR[c] if f not in inside or inside[f] < 2]
            keep += [f"g {g}" for g in (*GROUP_WORDS, "people")]
            ids = {f: i for i, f in enumerate(dict.fromkeys(keep))}
            prior = np.array([PRIOR[c].get(f, 0.0) for f in ids])
            rows, grade, weight = [], [], []
            empty = 0
            for f, g in chosen:
                got = [ids[x] for x in f if x in ids]
                if not got and not g:
                    empty += 1
                    continue
                rows.append(got)
                grade.append(g)
                weight.append(1.0)
            rows.append([])
            grade.append(0)
            weight.append(min(float(empty), 5000.0))
            w, low[c] = _solve(rows, np.array(grade), np.array(weight), prior)
            weights[c] = {f: float(w[i]) for f, i in ids.items()}
        model = Severity(weights, low)
    return model


def model(documents: DataFrame, labels: DataFrame, most: int = MAX_REVIEWED) -> Severity:
    """Model fitted on at most `most` reviewed documents, chosen by hash of doc_id."""
    votes = labels.where("category is not null").groupBy("doc_id").agg(F.collect_list("category").alias("votes"))
    rows = documents.where("length(trim(text)) > 0").groupBy("doc_id").agg(F.min("text").alias("text")).join(votes, "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("text", "votes").collect()
    return fit([(r.text, Counter(r.votes)) for r in got])


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        severity: Severity = shared.value
        for pdf in batches:
            out = []
            for doc_id, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
                for c, (value, _) in zip(severity.names, severity.worst(text), strict=True):
                    out.append((doc_id, source, c, round(value, 4)))
            yield pd.DataFrame(out, columns=["doc_id", "source", "category", "severity"])

    return run


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected severity (0 to 2) of every document and category: doc_id, source, category, severity."""
    shared = documents.sparkSession.sparkContext.broadcast(model(documents, labels))
    once = documents.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d")).select("doc_id", "d.source", "d.text")
    return once.mapInPandas(_score(shared), "doc_id long, source string, category string, severity double")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p9_found: the categories of every document whose expected severity makes it a case."""
    return scores(documents, labels).where(F.col("severity") >= CASE).select("doc_id", "category")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Report per source and category: documents, cases, rate, mean severity; a null source stays null."""
    return (
        scores(documents, labels).groupBy("source", "category")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("severity") >= CASE).alias("cases"), F.avg("severity").alias("mean_severity"))
        .withColumn("rate", F.col("cases") / F.col("documents"))
    )
