"""Problem 7: encoding of the corpus with a public byte-pair tokenizer, by a tokenization automaton.

Method: the merges are compiled, in order of rank, into a deterministic automaton over token labels by one merge
gadget each. A gadget for the merge (u, v) -> w redirects every arc labelled u to a copy of its target without the
arc labelled v, and adds an arc labelled w to where u, v led. The states that arise are exactly one per token (the
label read last), and an arc is missing after all gadgets iff some gadget removed it. As the full arc table of 50,000
labels would be dense, a missing arc is decided from the gadgets when it is first asked for and then kept in the
transition table, so encoding a word is table look-ups only: for each end position the one token whose arc leaves the
state of the prefix before it. Decoding follows a path and emits the labels of its arcs.

Defined results: null and empty text give an empty list; text that only looks like a special token is ordinary text;
bytes are those of UTF-8, lone surrogates as U+FFFD; texts of any length are encoded whole. Each row keeps its
result, so repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Words kept with their ids per worker; only speed depends on it.
WORD_CACHE = 400_000
#: Arcs kept decided per worker; only speed depends on it.
ARC_CACHE = 2_000_000


class MergeAutomaton:
    """The automaton of one rank file: `encode` bytes to ids, `decode` ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.labels = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.gadget: dict[tuple[int, int], int] = {}  # (u, v) -> rank at which the arc v is cut after u
        self.parts: dict[int, tuple[int, int]] = {}  # w -> (u, v)
        self.open: dict[tuple[int, int], bool] = {}  # the transition table, filled as arcs are asked for
        for label, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(label) > 1 and (pair := self._split(label, rank)):
                self.gadget[pair] = rank
                self.parts[rank] = pair

    def _split(self, label: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merge of this rank joins: what the earlier merges make of the label."""
        parts = [label[i : i + 1] for i in range(len(label))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], rank))
            if self.ids.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if all(p in self.ids for p in parts) else None

    def _born(self, token: int) -> int:
        return token if token in self.parts else -1

    def _cut(self, a: int, b: int) -> bool:
        """Whether the gadgets have removed arc b from the state of a."""
        until = len(self.labels)
        while True:
            rank = self.gadget.get((a, b))
            if rank is not None and rank <= until:
                return True
            born_a, born_b = self._born(a), self._born(b)
            if born_a < 0 and born_b < 0:
                return False
            if born_a > born_b:  # the state of a is a copy of that of its right part, made before its own cut
                a, until = self.parts[a][1], min(until, born_a - 1)
            else:  # the arc b stands where the arc of its left part stood, after its own cut
                b, until = self.parts[b][0], min(until, born_b)

    def follows(self, a: int, b: int) -> bool:
        """Whether state a has an arc labelled b."""
        found = self.open.get((a, b))
        if found is None:
            if len(self.open) >= ARC_CACHE:
                self.open.clear()
            found = self.open[(a, b)] = not self._cut(a, b)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells `word`."""
        whole = self.ids.get(word)
        if whole is not None and (whole in self.parts or len(word) == 1):
            return [whole]
        n, ids, longest, follows = len(word), self.ids, self.longest, self.follows
        last: list[int] = [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(word[start:end])
                if token is not None and (start == 0 or (last[start] >= 0 and follows(last[start], token))):
                    last[end] = token
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return out[::-1]

    def decode(self, path: list[int]) -> bytes:
        return b"".join(self.labels[i] for i in path)


@lru_cache(maxsize=4)
def automaton(name: str, folder: str) -> MergeAutomaton:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return MergeAutomaton({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


# Fixed value: the pattern of the public vocabularies that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str, folder: str):
    """A function text -> ids, with the words met so far kept in a bounded table."""
    import regex

    machine, split = automaton(name, folder), regex.compile(PATTERN).findall
    words: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        if not isinstance(text, str):
            return out
        for word in split(text):
            ids = words.get(word)
            if ids is None:
                ids = machine.encode(word.encode("utf-8", "replace"))
                if len(word) <= 40:
                    if len(words) >= WORD_CACHE:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    return encode


def token_ids(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Column of the ids (array<int>) of a text column."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(encoder(name, folder))

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def token_count(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Column of the number of ids of a text column; the ids don't leave the worker."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        encode = encoder(name, folder)
        return texts.map(lambda t: len(encode(t))).astype("int64")

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def decoded(ids: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Column of the text that a list of ids stands for; null ids give ''."""

    @F.pandas_udf(T.StringType())
    def run(paths: pd.Series) -> pd.Series:
        machine = automaton(name, folder)
        return paths.map(lambda p: machine.decode(list(p)).decode("utf-8", "replace") if p is not None else "")

    return run(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """p7_ids: doc_id and ids of every document."""
    return documents.select("doc_id", token_ids("text", name, folder).alias("ids"))
