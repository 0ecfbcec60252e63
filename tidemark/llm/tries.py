"""Trie join: pairs of strings within a bounded edit distance, by Levenshtein automata run over sharded tries.

Known strings are cut into as many pieces as edits are allowed and one more, so a spelling within the bound keeps one
piece whole, at most as many places away as edits are allowed. Length, number and text of the piece name the shard; a
query visits only the shards that its own substrings name. No pair within the bound is missed, none outside comes out.

The strings of a shard are one trie, kept as flat arrays of nodes by depth. All visits of a task go down their tries
together, a letter at a time: the state of a visit's automaton is its band of bounded distances (as many letters of the
query before and after the depth as edits are allowed), a step moves all states at once, and dead states are dropped.
Visits go in portions, and a portion with more than STATES states to come is halved, so memory grows neither with the
shard nor with the visits. A shard of many strings or of many queries is split by hash of either, so that a piece that a
third of all names share is many tasks' work. A task reads the strings of one bucket at a time, and its queries and pairs
pass through it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import slips_allowed
from tidemark.llm.spelling import code_points
from tidemark.session import materialize

#: Most edits that slips_allowed() ever allows.
MOST = 3
#: Visits that go down the tries at once, and queries or strings of one shard beyond which it is split.
PORTION, SPLIT = 20_000, 20_000
#: States that are moved at once, and pairs that are written at once.
STATES, PAIRS = 300_000, 50_000
#: Visits, or strings, of one bucket.
TASK = 100_000

_DEAD = np.uint8(9)


class Tries:
    """Tries of shards: `words` in order of shard, distinct within a shard and of equal length there."""

    def __init__(self, shards: np.ndarray, words: list[str]):
        letters = code_points(words)
        self.size = np.array([len(w) for w in words], np.int32)
        # the number of first letters that a word shares with the one before in its shard
        new = np.ones(len(words), bool)
        new[1:] = shards[1:] != shards[:-1]
        same = np.zeros(letters.shape, bool)
        same[1:] = letters[1:] == letters[:-1]
        shared = np.where(new, -1, np.where(same.all(axis=1), letters.shape[1], (~same).argmax(axis=1)))
        self.first = np.flatnonzero(new)  # the root of every shard, in order
        self.chars: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.start: list[np.ndarray] = []  # children of node x of a depth: start[x] to start[x + 1] of the next depth
        self.word: list[np.ndarray] = []  # first word below a node: the word itself where it ends here
        node = np.cumsum(new) - 1
        rows = np.arange(len(words))
        for depth in range(1, int(self.size.max(initial=0)) + 1):
            self.word.append(rows[np.unique(node, return_index=True)[1]] if depth > 1 else self.first)
            deep = self.size[rows] >= depth
            parents = len(self.word[-1])
            rows, node = rows[deep], node[deep]
            fresh = shared[rows] < depth
            self.start.append(np.searchsorted(node[fresh], np.arange(parents + 1)))
            self.chars.append(letters[rows[fresh], depth - 1])
            node = np.cumsum(fresh) - 1
        self.word.append(rows[np.unique(node, return_index=True)[1]] if len(rows) else rows)

    def walk(self, roots: np.ndarray, queries: np.ndarray, size: np.ndarray, edits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(visit, word, distance) of every word that the automaton of a visit accepts, portion by portion.

        A visit is a root (number of the shard), a query (row of code points), its size and the edits allowed.
        """
        padded = np.zeros((queries.shape[0], queries.shape[1] + 2 * MOST + int(self.size.max(initial=0)) + 1), np.uint32)
        padded[:, MOST : MOST + queries.shape[1]] = queries
        # column o of a state: distance of the path to the first depth + o - MOST letters of the query
        state = np.full((2 * MOST + 1, len(roots)), _DEAD, np.uint8)
        for o in range(MOST, 2 * MOST + 1):
            state[o] = np.where(size >= o - MOST, o - MOST, _DEAD)
        todo = [(1, np.arange(len(roots)), roots, state)] if len(roots) else []
        while todo:
            depth, visit, node, before = todo.pop()
            if depth >= len(self.chars):
                continue
            low = self.start[depth - 1][node]
            many = self.start[depth - 1][node + 1] - low
            if not many.sum():
                continue
            if many.sum() > STATES and len(node) > 1:
                half = len(node) // 2
                todo += [(depth, visit[part], node[part], before[:, part]) for part in (slice(half, None), slice(half))]
                continue
            parent = np.repeat(np.arange(len(node)), many)
            node = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + low[parent]
            visit = visit[parent]
            char = self.chars[depth][node]
            state = np.full((2 * MOST + 1, len(node)), _DEAD, np.uint8)
            length, bound = size[visit], edits[visit]
            for o in range(2 * MOST + 1):
                at = depth + o - MOST  # letters of the query read in this column
                if at < 0:
                    continue
                cell = before[o][parent] + (padded[visit, at + MOST - 1] != char) if at else np.full(len(node), _DEAD, np.uint8)
                if o < 2 * MOST:
                    cell = np.minimum(cell, before[o + 1][parent] + 1)
                if o:
                    cell = np.minimum(cell, state[o - 1] + 1)
                state[o] = np.where(at <= length, np.minimum(cell, _DEAD), _DEAD)
            alive = state.min(axis=0) <= bound
            visit, node, state = visit[alive], node[alive], state[:, alive]
            todo.append((depth + 1, visit, node, state))
            word = self.word[depth][node]
            shift = size[visit] - depth + MOST
            ends = (self.size[word] == depth) & (shift >= 0) & (shift <= 2 * MOST)
            if ends.any():
                distance = state[shift[ends], np.flatnonzero(ends)]
                good = distance <= edits[visit[ends]]
                if good.any():
                    yield visit[ends][good], word[ends][good], distance[good]


def pieces(length: int, k: int) -> list[tuple[int, int, int]]:
    """(number, from, to) of the k + 1 pieces of a word of this length."""
    cuts = [round(i * length / (k + 1)) for i in range(k + 2)]
    return [(i, cuts[i], cuts[i + 1]) for i in range(k + 1)]


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for word in pdf["known"]:
            out += [(f"{len(word)}|{i}|{word[a:b]}", word) for i, a, b in pieces(len(word), slips_allowed(len(word)))]
        yield pd.DataFrame(out, columns=["shard", "known"])


def _probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for word in pdf["query"]:
            n = len(word)
            names = set()
            for length in range(max(1, n - MOST), n + MOST + 1):
                k = slips_allowed(length)
                shift = n - length
                if abs(shift) > k:
                    continue
                for i, a, b in pieces(length, k):
                    lo, hi = max(0, a - i, a + shift - (k - i)), min(n - (b - a), a + i, a + shift + (k - i))
                    names.update(f"{length}|{i}|{word[at : at + b - a]}" for at in range(lo, hi + 1))
            out += [(name, word) for name in names]
        yield pd.DataFrame(out, columns=["shard", "query"])


class _Bucket:
    """The strings of a bucket, in order of shard and string, as tries that queries walk down."""

    def __init__(self, known: pd.DataFrame):
        self.words = known["word"].tolist()
        shards, names = pd.factorize(known["shard"])
        self.tries = Tries(shards, self.words)
        self.numbers = pd.Series(np.arange(len(names)), index=names)
        self.edits = np.array([slips_allowed(int(self.tries.size[i])) for i in self.tries.first], np.uint8)

    def pairs(self, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(queries), PORTION):
            yield from self._portion(queries.iloc[at : at + PORTION])

    def _portion(self, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        roots = queries["shard"].map(self.numbers)
        typed = queries["word"][roots.notna()].tolist()
        roots = roots[roots.notna()].to_numpy(np.int64)
        size = np.array([len(w) for w in typed], np.int32)
        for visit, word, slips in self.tries.walk(roots, code_points(typed), size, self.edits[roots]):
            for at in range(0, len(visit), PAIRS):
                some = slice(at, at + PAIRS)
                yield pd.DataFrame({"query": [typed[v] for v in visit[some]], "known": [self.words[w] for w in word[some]], "slips": slips[some].astype(np.int32)})


def _gathered(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about PAIRS, each pair once in a frame (the pieces of one spelling lie in several shards)."""
    held: list[pd.DataFrame] = []
    for pdf in found:
        held.append(pdf)
        if sum(map(len, held)) >= PAIRS:
            yield pd.concat(held).drop_duplicates()
            held = []
    if held:
        yield pd.concat(held).drop_duplicates()


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of rows (bucket, typed, shard, word) in order of bucket: the known strings first, then the typed ones."""

    def found() -> Iterator[pd.DataFrame]:
        bucket, known, tries = None, [], None
        for pdf in batches:
            for (of, typed), rows in pdf.groupby(["bucket", "typed"], sort=True):
                if of != bucket:
                    bucket, known, tries = of, [], None
                if not typed:
                    known.append(rows)
                    continue
                if known:
                    tries, known = _Bucket(pd.concat(known, ignore_index=True)), []
                if tries:
                    yield from tries.pairs(rows)

    return _gathered(found())


def trie_join(queries: DataFrame, known: DataFrame, buckets: int | None = None) -> DataFrame:
    """Pairs (query, known, slips) of distinct strings with slips <= slips_allowed(length of known).

    `queries` has a column query, `known` a column known; null and empty strings match nothing. `buckets` is the number
    of groups that are worked on at once, by default one for TASK visits or strings.
    """
    index = known.select("known").where("known <> ''").distinct().mapInPandas(_index, "shard string, known string")
    index = materialize(index, "trie-index")
    probes = queries.select("query").where("query <> ''").distinct().mapInPandas(_probes, "shard string, query string")
    held = index.groupBy("shard").agg(F.count("*").alias("words"))
    # only shards that exist are visited
    probes = materialize(probes.join(held.select("shard"), "shard", "left_semi"), "trie-visits")
    asked = probes.groupBy("shard").agg(F.count("*").alias("visits"))
    size = asked.join(held, "shard").withColumns({"q_parts": F.ceil(F.col("visits") / SPLIT), "k_parts": F.ceil(F.col("words") / SPLIT)})
    size = materialize(size, "trie-sizes")
    hot = materialize(size.where("q_parts > 1 or k_parts > 1").select("shard", "q_parts", "k_parts"), "trie-hot")
    # visits and strings as they are after hot shards are split, where each part of either meets each of the other
    most = size.agg(F.sum(F.col("visits") * F.col("k_parts")), F.sum(F.col("words") * F.col("q_parts"))).first()
    buckets = buckets or max(m or 0 for m in most) // TASK + 1
    index = index.join(asked.select("shard"), "shard", "left_semi")

    def split(df: DataFrame, word: str, own: str, other: str) -> DataFrame:
        df = df.join(hot, "shard", "left").fillna(1, ["q_parts", "k_parts"])
        df = df.withColumn("mine", F.pmod(F.xxhash64(word), F.col(own))).withColumn("theirs", F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))))
        q, k = ("mine", "theirs") if word == "query" else ("theirs", "mine")
        at = F.pmod(F.xxhash64("shard", F.col(q).cast("long"), F.col(k).cast("long")), F.lit(buckets))
        return df.select(at.alias("bucket"), F.lit(word == "query").alias("typed"), "shard", F.col(word).alias("word"))

    rows = split(probes, "query", "q_parts", "k_parts").unionByName(split(index, "known", "k_parts", "q_parts"))
    # a task may take several buckets, one after the other
    rows = rows.repartition(int(min(buckets, 2000)), "bucket").sortWithinPartitions("bucket", "typed", "shard", "word")
    pairs = rows.mapInPandas(_walk, "query string, known string, slips int")
    return pairs.groupBy("query", "known").agg(F.min("slips").alias("slips"))
