"""Problem 6: speech transcripts into clean, ordered speaker turns.

Method: the timed segments of a video are swept in order of start; every segment is cut where a speaker label stands,
labels are matched with the credited speakers, repetition of rolling captions is removed by the longest suffix of the
segment before that is a prefix of this one (of REPEAT_WORDS words at least, of any where the two overlap in time), and
turns are split at speaker changes; within a turn, parts are split at pauses longer than the video's own calibrated pause.

The sweep carries who speaks, and for turns() the piece before, along a video. It runs in two steps, over time slots of
SLOT_S seconds and over the last value of each slot, so a stream that holds a third of all rows isn't one task's load.

Defined results: segments sent twice count once; a null start sorts after the others, by segment_index; null text,
blank text, annotations and hesitations alone hold no spoken words and never begin or end a turn; words before the
first label of a video belong to its first speaker; an unknown label is part of the text; videos without speakers have
speaker_no 0. Videos without segments, and empty tables, have no turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.spelling import plain, within
from tidemark.session import materialize

#: Seconds of a slot, the most that one task sweeps of one video at once.
SLOT_S = 3600
#: Segments without a start are swept in slots of so many.
SLOT_SEGMENTS = 1000
#: Words that two neighbours must share to be a repetition where they don't overlap in time.
REPEAT_WORDS = 3

# Hesitations by language (the text is raw speech-to-text of these languages).
HESITATIONS = frozenset(
    "um umm uhm uh uhh er err erm hmm hm mm mmm mhm eh ehm em emm eee ee äh ähm öh hum euh heu bah hã hãã anu "
    "हम्म अम्म उम उह आह एर hmmm umh อืม เอ่อ อ่า แบบว่า mah boh ahm ah aah".split()
)
# Words that are a hesitation only where a pause mark follows them.
PAUSED = frozenset("este cioè matlab yani né tipo คือ".split())

_TIME = re.compile(r"^\s*(?:[\[(]\s*)?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*(?:[\])])?\s*(?:-\s+)?")
_ARROWS = re.compile(r"^\s*(?:>>+|»|-)\s*")
_BRACKET = re.compile(r"<v\s+([^>]{1,60})>|[\[(<]([^\[\]()<>]{1,60})[\])>]\s*:?|\*[^*]{1,60}\*|♪+[^♪]*♪+|♪+")
_MARKED = re.compile(r"[\[(<*♪>]|:\s|\s-\s")
_COLON = re.compile(r"\s*(?::\s|\s-\s)")
_SPACE = re.compile(r"\s+")
_NAMEWORD = re.compile(r"[^\s,;:!?()\[\]<>]+")


def _names(credit: str) -> tuple[list[str], str]:
    name, _, role = credit.partition("(")
    return plain(name).split(), plain(role)


@lru_cache(maxsize=100_000)
def speaker_of(label: str, speakers: tuple[str, ...]) -> int:
    """The 1-based position in `speakers` that a label names, 0 if it names none; the first of equals."""
    said = plain(label)
    words = said.split()
    if not words or len(words) > 4:
        return 0
    credits = [_names(c) for c in speakers]
    glued, first, close = "".join(words), [], []
    for number, (name, role) in enumerate(credits, 1):
        if not name:
            continue
        f, l = name[0], name[-1]  # noqa: E741
        exact = {" ".join(name), f"{l} {' '.join(name[:-1])}"} if len(name) > 1 else {f}
        short = {f"{f} {l[0]}", f"{f[0]} {l}", f"{l} {f[0]}"} if len(name) > 1 else set()
        loose = {f, l, role} - {""}
        if len(name) > 1:
            loose.add(f"{f[0]} {l[0]}")
        if said in exact:
            first.append((0, number))
        elif said in short:
            first.append((1, number))
        elif said in loose or (len(name) > 1 and glued == f[0] + l[0]):
            first.append((2, number))
        else:
            for form in exact | short | loose:
                same = len(form.split()) == len(words)
                k = 0 if len(form) < 3 else 1 if len(form) < 6 else 2
                if same and k and form[:1].isalpha() and (d := within(said, form, k)) <= k:
                    close.append((d, number))
    found = min(first, default=None) or min(close, default=None)
    return found[1] if found else 0


@lru_cache(maxsize=200_000)
def is_hesitation(word: str) -> bool:
    bare = word.strip(".,!?…;:-\"'“”").lower()
    return bare in HESITATIONS or (bare in PAUSED and word[-1:] in ",…." and word != bare)


def clean(text: str) -> str:
    """`text` without hesitations and doubled spaces."""
    words = [w for w in text.split() if not is_hesitation(w)]
    return " ".join(words).strip(" -–—,")


def cut_segment(text: str | None, speakers: tuple[str, ...]) -> list[tuple[int, str]]:
    """The pieces of a segment as (speaker_no or 0 for 'as before', clean text); a label without words gives ''."""
    if not text:
        return []
    rest = " ".join(text.split())
    rest = _TIME.sub("", rest, count=1)
    if not _MARKED.search(rest):  # no label, no annotation: one piece
        said = clean(_arrows(rest))
        return [(0, said)] if said else []
    marks: list[tuple[int, int, int]] = []  # from, to, speaker (-1: annotation)
    for m in _BRACKET.finditer(rest):
        label = m.group(1) or m.group(2)
        number = speaker_of(label, speakers) if label else 0
        marks.append((m.start(), m.end(), number or -1))
    for m in _COLON.finditer(rest):
        if any(a <= m.start() < b for a, b, _ in marks):
            continue
        begin = max([b for a, b, _ in marks if b <= m.start()], default=0)
        words = list(_NAMEWORD.finditer(rest, begin, m.start()))[-3:]
        for k in range(len(words)):
            at = words[k].start()
            label = rest[at : m.start()]
            if label.lstrip(">").strip() and (number := speaker_of(label, speakers)):
                if k + 1 < len(words) and label.count(" ") > 1 and not speaker_of(label, speakers):
                    continue
                marks.append((at, m.end(), number))
                break
    marks.sort()
    pieces: list[tuple[int, str]] = []
    speaker, at, buffer = 0, 0, ""
    for a, b, number in marks:
        if a < at:
            continue
        buffer += " " + rest[at:a]
        if number > 0:
            said = clean(_arrows(buffer))
            if said or speaker:
                pieces.append((speaker, said))
            speaker, buffer = number, ""
        at = b
    buffer += " " + rest[at:]
    said = clean(_arrows(buffer))
    if said or speaker:
        pieces.append((speaker, said))
    return pieces


def _arrows(text: str) -> str:
    text = text.replace(">>", " ").strip()
    return _ARROWS.sub("", _TIME.sub("", text, count=1) if text[:1] in "[(0123456789" else text)


_HAS_WORD = re.compile(r"\w", re.UNICODE)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["video_id", "slot", "start", "ends", "segment_index", "piece", "said_by", "first", "words", "text"]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            speakers = tuple(s or "" for s in r.speakers) if r.speakers is not None else ()
            for k, (number, text) in enumerate(cut_segment(r.text, speakers)):
                out.append((r.video_id, r.slot, r.start, r.ends, r.segment_index, k, number or None, min(len(speakers), 1), bool(_HAS_WORD.search(text)), text))
        frame = pd.DataFrame(out, columns=names)
        frame["said_by"] = frame["said_by"].astype("Int32")
        yield frame


def current_videos(videos: DataFrame) -> DataFrame:
    """Each video once, as last fetched: video_id and speakers (never null)."""
    last = F.max_by(F.struct("speakers"), F.struct(F.coalesce("fetched_at", F.lit(0).cast("timestamp")), F.size(F.coalesce("speakers", F.array())))).alias("v")
    return videos.where("video_id is not null").groupBy("video_id").agg(last).select("video_id", F.coalesce("v.speakers", F.array()).alias("speakers"))


def pieces(videos: DataFrame, transcripts: DataFrame, least_speakers: int = 0, written: bool = False) -> DataFrame:
    """Labelled pieces of segments with the speaker carried on: a row per piece with spoken words.

    Columns video_id, slot, start, ends, segment_index, piece, speaker_no, text. `written` keeps the cut segments as a
    table, for those who read the rows several times with their text.
    """
    who = current_videos(videos).where(F.size("speakers") >= least_speakers)
    once = transcripts.groupBy("video_id", "segment_index").agg(F.min(F.struct("start", "text", "duration")).alias("s"))
    slot = F.when(F.col("s.start").isNotNull(), F.floor(F.col("s.start") / SLOT_S)).otherwise(F.lit(10**9) + F.floor(F.col("segment_index") / SLOT_SEGMENTS))
    rows = once.select("video_id", "segment_index", "s.start", "s.text", (F.col("s.start") + F.coalesce("s.duration", F.lit(0.0))).alias("ends"), slot.cast("long").alias("slot"))
    parts = rows.join(who, "video_id").mapInPandas(
        _pieces,
        "video_id string, slot long, start double, ends double, segment_index int, piece int, said_by int, first int, words boolean, text string",
    )
    if written:
        parts = materialize(parts, "pieces")
    order = F.struct(F.col("start").isNull(), "start", "segment_index", "piece")
    labelled = F.col("said_by").isNotNull()
    last = parts.groupBy("video_id", "slot").agg(F.max_by(F.when(labelled, F.col("said_by")), F.when(labelled, order)).alias("last"))
    before = Window.partitionBy("video_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("video_id", "slot", F.last("last", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy("video_id", "slot").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce(F.last("said_by", ignorenulls=True).over(inside), "carry", "first")
    return parts.join(carry, ["video_id", "slot"]).withColumn("speaker_no", number).where("words").drop("carry", "said_by", "first", "words")


def _order() -> tuple[Column, ...]:
    return F.col("start").isNull(), F.col("start"), F.col("segment_index"), F.col("piece")


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` of pieces() with turn_no, counted from 1 within each video in two steps like the carry."""
    slot = Window.partitionBy("video_id", "slot").orderBy(*_order())
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_order())])
    rows = rows.withColumn("_prev", F.lag("speaker_no").over(slot))
    edge = rows.groupBy("video_id", "slot").agg(
        F.min_by("speaker_no", order).alias("first"), F.max_by("speaker_no", order).alias("last"),
        F.count_if(F.col("_prev") != F.col("speaker_no")).alias("changes"),
    )
    video = Window.partitionBy("video_id").orderBy("slot")
    starts = edge.withColumn("new", (~F.col("first").eqNullSafe(F.lag("last").over(video))).cast("int"))
    offset = F.sum(F.col("new") + F.col("changes")).over(video.rowsBetween(Window.unboundedPreceding, 0)) - F.col("changes")
    starts = starts.select("video_id", "slot", offset.alias("offset"))
    change = F.sum(F.when(F.col("_prev") != F.col("speaker_no"), 1).otherwise(0)).over(slot.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", change).join(starts, ["video_id", "slot"]).withColumn("turn_no", (F.col("offset") + F.col("_n")).cast("int")).drop("_prev", "_n", "offset")


def found(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """p6_found: the turns of videos that credit two or more speakers; repetition isn't cut here, repeated words are spoken words."""
    rows = numbered(pieces(videos, transcripts, 2))
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_order())])
    return rows.groupBy("video_id", "turn_no").agg(
        F.first("speaker_no").alias("speaker_no"),
        F.min_by("segment_index", order).alias("first_segment"),
        F.max_by("segment_index", order).alias("last_segment"),
    )


def trim_repeat(before: str | None, text: str, least: int = 1) -> str:
    """`text` without its longest prefix of words, `least` or more, that ends `before`."""
    a, b = (before or "").casefold().split(), text.casefold().split()
    strip = ".,!?…;:"
    a, bare = [w.strip(strip) for w in a], [w.strip(strip) for w in b]
    for k in range(min(len(a), len(bare)), least - 1, -1):
        if a[-k] == bare[0] and a[-k:] == bare[:k]:
            return " ".join(text.split()[k:])
    return text


@F.pandas_udf(T.StringType())
def _trim(before: pd.Series, text: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([trim_repeat(b, t, k) for b, t, k in zip(before, text, least, strict=True)])


def turns(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Clean turns of every video, in parts split at calibrated pauses.

    Columns video_id, turn_no, part_no (from 1 within the turn), speaker_no, speaker (name without role, null if none
    is credited), start, ends, text. A pause is calibrated per video: four times the median gap, at least two seconds.
    """
    rows = numbered(pieces(videos, transcripts, written=True))
    slot = Window.partitionBy("video_id", "slot").orderBy(*_order())
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_order())])
    video = Window.partitionBy("video_id").orderBy("slot")
    # the first piece of a slot follows the last one of the slot before
    edge = rows.groupBy("video_id", "slot").agg(*[F.max_by(c, order).alias(c) for c in ("text", "ends", "turn_no")])
    edge = edge.select("video_id", "slot", *[F.lag(c).over(video).alias(f"_edge_{c}") for c in ("text", "ends", "turn_no")])
    begins = F.row_number().over(slot) == 1
    before = lambda c: F.when(begins, F.col(f"_edge_{c}")).otherwise(F.lag(c).over(slot))
    rows = rows.join(edge, ["video_id", "slot"]).withColumns({"_before": before("text"), "_ends": before("ends"), "_turn": before("turn_no")})
    least = F.when(F.col("start") < F.col("_ends"), 1).otherwise(REPEAT_WORDS)
    gap = F.col("start") - F.col("_ends")
    # by slot, so that the rows stay where they are
    pause = rows.groupBy("video_id").agg(F.greatest(4 * F.percentile_approx(F.when(gap >= 0, gap), 0.5), F.lit(2.0)).alias("pause"))
    pause = edge.select("video_id", "slot").join(pause, "video_id")
    new = F.when(F.col("_turn").isNull() | (F.col("_turn") != F.col("turn_no")) | (gap > F.coalesce("pause", F.lit(2.0))), 1).otherwise(0)
    rows = rows.withColumn("text", _trim("_before", "text", least)).join(pause, ["video_id", "slot"])
    rows = rows.withColumn("_part", F.sum(new).over(slot.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(_order())], F.col("text").alias("text"))
    joined = lambda c: F.concat_ws(" ", F.filter(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), lambda x: x != ""))
    # parts of slots, counted from 0 where the slot goes on with the part before, then put together over slots
    parts = rows.groupBy("video_id", "turn_no", "slot", "_part").agg(
        F.first("speaker_no").alias("speaker_no"), F.min("start").alias("start"), F.max("ends").alias("ends"), joined(texts).alias("text")
    )
    offset = rows.groupBy("video_id", "slot").agg(F.max("_part").alias("n")).select(
        "video_id", "slot", F.coalesce(F.sum("n").over(video.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
    )
    parts = parts.join(offset, ["video_id", "slot"]).withColumn("_part", F.col("_offset") + F.col("_part"))
    parts = parts.groupBy("video_id", "turn_no", "_part").agg(
        F.first("speaker_no").alias("speaker_no"), F.min("start").alias("start"), F.max("ends").alias("ends"), joined(F.struct("slot", "text")).alias("text")
    )
    part = F.row_number().over(Window.partitionBy("video_id", "turn_no").orderBy("_part")).cast("int")
    names = current_videos(videos).withColumnRenamed("speakers", "_speakers")
    name = F.trim(F.split_part(F.try_element_at("_speakers", F.nullif("speaker_no", F.lit(0))), F.lit("("), F.lit(1)))
    return parts.withColumn("part_no", part).join(names, "video_id").select("video_id", "turn_no", "part_no", "speaker_no", name.alias("speaker"), "start", "ends", "text")
