"""Cutting texts and transcripts into windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_windows(rows: DataFrame, key: str, start: str, duration: str, length: int, step: int) -> DataFrame:
    """Segments per window [w, w + length) of each key, w a multiple of step: a segment counts where it overlaps.

    Each segment names the windows it overlaps, so nothing is joined.
    """
    a, b = F.col(start), F.col(start) + F.col(duration)
    first = F.greatest(F.floor((a - length) / step) + 1, F.lit(0))
    last = F.ceil(b / step) - 1
    w = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(key, F.explode(w).alias("n")).groupBy(key, (F.col("n") * step).alias("window_start")).agg(F.count("*").alias("segments"))


def word_windows(rows: DataFrame, key: str, text: str, length: int, step: int) -> DataFrame:
    """Windows of `length` words every `step` words, with a digest of their text."""
    w = F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))
    rows = rows.select(key, w.alias("w")).withColumn("p", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(step))))
    part = F.slice("w", F.col("p") + 1, length)
    return rows.select(key, F.col("p").cast("long").alias("word_from"), F.size(part).alias("words"), F.md5(F.array_join(part, " ")).alias("digest"))


# Openings that mark a change of topic.
SHIFT = re.compile(r"^\W*(?:next|now|so|okay|finally|by the way|after lunch|on our second day|last night|this morning|right now|anyway)\b", re.IGNORECASE)
LEAST, MOST, OVERLAP = 120.0, 420.0, 3


def fold_shifts(starts: list[float], shifts: list[bool]) -> list[tuple[int, int]]:
    """(first, last) positions of chunks: cut at a topic shift after LEAST seconds and at MOST seconds, OVERLAP segments shared."""
    out, first = [], 0
    for i in range(1, len(starts)):
        long = starts[i] - starts[first]
        if long >= MOST or (long >= LEAST and shifts[i]):
            out.append((first, i - 1))
            first = max(first + 1, i - OVERLAP)
    if starts:
        out.append((first, len(starts) - 1))
    return out


def fold_chunks(starts: list[float], texts: list[str]) -> list[tuple[int, int]]:
    """fold_shifts of texts."""
    return fold_shifts(starts, [bool(SHIFT.match(t)) for t in texts])


@F.pandas_udf(T.BooleanType())
def _shift(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bool(SHIFT.match(t))).astype(bool)


def semantic(rows: DataFrame) -> DataFrame:
    """Chunks by topic shift per video, in one fold over the whole video.

    Shifts are found before, over all partitions, so that the fold of a long stream holds starts, indexes and flags only.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "segment_index"])
        index = pdf["segment_index"].tolist()
        parts = fold_shifts(pdf["start"].tolist(), pdf["shift"].tolist())
        return pd.DataFrame([(key[0], k, index[a], index[b]) for k, (a, b) in enumerate(parts)], columns=["video_id", "chunk", "first_segment", "last_segment"])

    rows = rows.select("video_id", "segment_index", "start", _shift("text").alias("shift"))
    return rows.groupBy("video_id").applyInPandas(run, "video_id string, chunk long, first_segment int, last_segment int")
