"""Folding of typed names: one form for the spellings that people use for the same sound."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Results that a function keeps: every Python worker has such a cache of each, so they are bounded by words in use, not by the input.
CACHED = 20_000

_MARKS = re.compile(r"[^\w\s]|_", re.UNICODE)
_SPACE = re.compile(r"\s+")
_DOUBLE = re.compile(r"(.)\1+")

# Letter rewrites that unify spellings of one sound, applied from left to right.
_SOUNDS = (("ph", "f"), ("oo", "u"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("j", "i"))


@lru_cache(maxsize=CACHED)
def plain(text: str | None) -> str:
    """Lower case, no accents, letters and digits with single spaces; '' for null."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return _SPACE.sub(" ", _MARKS.sub(" ", text)).strip()


@lru_cache(maxsize=CACHED)
def sound(text: str) -> str:
    """`text` (already plain, spaces dropped) by sound: doubled letters once, silent h dropped, like letters unified."""
    text = text.replace(" ", "")
    for old, new in _SOUNDS:
        text = text.replace(old, new)
    if text:
        text = text[0] + text[1:].replace("h", "")
    return _DOUBLE.sub(r"\1", text)


def grams(text: str, n: int = 2) -> list[str]:
    """The distinct n-grams of the padded text, sorted."""
    if not text:
        return []
    padded = f"^{text}$"
    return sorted({padded[i : i + n] for i in range(len(padded) - n + 1)})


def within(a: str, b: str, k: int) -> int:
    """Edit distance with adjacent transpositions, or k + 1 when it is larger than k."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    before, last = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [k + 1] * m
        lo, hi = max(1, i - k), min(m, i + k)
        best = row[0] if lo == 1 else k + 1
        ca = a[i - 1]
        for j in range(lo, hi + 1):
            cb = b[j - 1]
            d = min(last[j - 1] + (ca != cb), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, before[j - 2] + 1)
            row[j] = d
            if d < best:
                best = d
        if best > k:
            return k + 1
        before, last = last, row
    return min(last[m], k + 1)


def code_points(words: list[str]) -> np.ndarray:
    """Words as a matrix of code points, a row each, filled up with zeros."""
    longest = max(map(len, words), default=0)
    return np.array(words, dtype=f"<U{max(longest, 1)}").view(np.uint32).reshape(len(words), max(longest, 1))


def within_many(a: list[str], b: list[str], k: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """within() of many pairs at once, `k` per pair: the same table of distances, a cell of all pairs at a time."""
    k = np.asarray(k, np.int16)
    out = k + 1
    size_a, size_b = np.array([len(x) for x in a], np.int32), np.array([len(x) for x in b], np.int32)
    todo = np.flatnonzero(np.abs(size_a - size_b) <= k)
    todo = todo[np.argsort(size_a[todo] + size_b[todo], kind="stable")]  # pairs of like sizes together
    for at in range(0, len(todo), chunk):
        some = todo[at : at + chunk]
        out[some] = np.minimum(_distances([a[i] for i in some], [b[i] for i in some], size_a[some], size_b[some], int(k[some].max())), k[some] + 1)
    return out.astype(np.int32)


def _distances(a: list[str], b: list[str], size_a: np.ndarray, size_b: np.ndarray, k: int) -> np.ndarray:
    x, y = np.ascontiguousarray(code_points(a).T), np.ascontiguousarray(code_points(b).T)
    count, far = len(a), np.int16(k + 1)
    n, m = int(size_a.max()), int(size_b.max())
    out = np.full(count, far, np.int16)
    edge = np.full(count, far, np.int16)
    before: dict[int, np.ndarray] = {}
    last = {j: np.full(count, min(j, k + 1), np.int16) for j in range(min(m, k) + 1)}
    out[size_a == 0] = np.minimum(size_b[size_a == 0], k + 1)
    for i in range(1, n + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if j == 0:
                row[j] = np.full(count, min(i, k + 1), np.int16)
                continue
            cell = np.minimum(last.get(j, edge), row.get(j - 1, edge)) + 1
            np.minimum(cell, last.get(j - 1, edge) + (x[i - 1] != y[j - 1]), out=cell)
            if i > 1 and j > 1 and j - 2 in before:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                cell = np.where(swapped, np.minimum(cell, before[j - 2] + 1), cell)
            row[j] = cell
        ends = size_a == i
        if ends.any():
            for j in row:
                at = ends & (size_b == j)
                out[at] = row[j][at]
        before, last = last, row
    return np.minimum(out, far)
