"""Problem 2: language of every video, segment and part of a segment, with a confidence.

Method: nearest-centroid classification. Normalised TF-IDF vectors of letter n-grams and words are clustered into
several centroids per language (spherical k-means started from every label's own texts, clusters named by the majority
of their labels, so wrong labels don't form a language); texts are compared with all centroids by cosine. As dot
products add up over words, a segment is cut into runs of one language by a Viterbi pass over its words' cosines; each
run is then classified as a whole and rejected when its nearest centroid is too far (names, noises, other languages).

Defined results: names (capitalised words in a row, letters that no labelled text has), hesitations, sound annotations,
speaker labels and numbers have no language; text without any words, null or blank text gives no row; equal cosines go
to the language that sorts first; repeated segments count once; without labelled documents nothing is classified.
The classifier is fitted on a bounded sample of labelled rows, about SAMPLE_PER_LABEL of each language of LANGUAGE_NAMES;
all else covers all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.turns import current_videos, cut_segment

#: Labelled documents of each label that the centroids are fitted on (about; by hash of doc_id).
SAMPLE_PER_LABEL = 300
#: Centroids that each label starts with.
CENTROIDS = 4
#: Share of a cluster's votes that its language must have for the centroid to stay.
PURITY = 0.85
#: Features kept, by document frequency.
FEATURES = 40_000
#: Weight of a whole word beside its letter n-grams.
WORD_WEIGHT = 2.0
#: Cosine to the nearest centroid under which a run has no known language.
MIN_COSINE = 0.08
#: Cost of a change of language between two words of a segment, in units of a clear word's lead.
SWITCH = 2.6
#: Words that a run must have to count as spoken in another language.
MIN_RUN = 3
#: Words up to which a segment is compared together with others, and words compared at once.
TOGETHER, AT_ONCE = 64, 30_000
#: Words and word sequences that a worker keeps.
KEPT_WORDS, KEPT_RUNS = 300_000, 200_000

# Names and codes of languages, ISO 639 two- and three-letter codes, English and own names.
LANGUAGE_NAMES = {
    "en": "en eng english", "es": "es spa spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch", "it": "it ita italian italiano", "pt": "pt por portuguese português portugues",
    "id": "id ind in indonesian indonesia bahasa", "hi": "hi hin hindi हिन्दी हिंदी", "th": "th tha thai ไทย ภาษาไทย",
    "nl": "nl nld dut dutch nederlands", "gl": "gl glg galician galego", "ca": "ca cat catalan català", "ur": "ur urd urdu",
    "lo": "lo lao", "ne": "ne nep nepali", "ms": "ms msa may malay melayu",
}
CODES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}

_TOKEN = re.compile("[\\w\u0300-\u036f\u0900-\u0963\u0966-\u097f\u0e00-\u0e7f'\u2019-]+")
_DECOY = re.compile(r"^\s*(?:fun fact|update|price|note|tip)\s*:\s*", re.IGNORECASE)


def code_of(label: str | None) -> str | None:
    """The two-letter code a label stands for in whatever notation, None if it names no language."""
    if not isinstance(label, str):
        return None
    base = re.split(r"[-_\s(]", unicodedata.normalize("NFKC", label).strip().casefold(), maxsplit=1)[0]
    return CODES.get(base)


@lru_cache(maxsize=200_000)
def _forms(token: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a token is capitalised, and its words: itself in lower case, or parts of Thai letters; none for numbers."""
    if not token[:1].isalpha():
        return False, ()
    if token[0] > "\u0dff" and any("\u0e00" <= c <= "\u0e7f" for c in token):
        return False, tuple(token[i : i + 4] for i in range(0, len(token), 4))
    return token[0].isupper(), (token.casefold(),)


def spoken_words(text: str) -> list[str]:
    """Words without names: two or more capitalised words in a row are one, a single one inside is marked as doubtful."""
    if ":" in text:
        text = _DECOY.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    tokens = _TOKEN.findall(text)
    forms = [_forms(t) for t in tokens]
    out: list[str] = []
    before = False
    last = len(forms) - 1
    for k, (capital, words) in enumerate(forms):
        if capital:
            if (before or (k < last and forms[k + 1][0])) and len(tokens[k]) > 1:
                before = True
                continue
            before = True
            out.append(words[0] if k == 0 else "\u0001" + words[0])
        else:
            before = False
            out += words
    return out


def features(word: str) -> list[str]:
    """The word itself and its letter n-grams of 1 to 4 with the word's ends marked."""
    padded = f" {word} "
    out = ["w:" + word]
    for n in (2, 3, 4):
        out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    out += word[:1] if word[:1] > "\u02ff" else []
    return out


class Centroids:
    """Centroids of languages and the words' dot products with them, kept per word met."""

    def __init__(self, languages: list[str], owner: np.ndarray, vocab: dict[str, int], idf: np.ndarray, matrix: np.ndarray, known: frozenset[str]):
        self.languages, self.owner, self.vocab, self.idf, self.matrix, self.known = languages, owner, vocab, idf, matrix, known
        # centroids of a language lie together, so that a language's best is one slice's maximum
        order = np.argsort(owner, kind="stable")
        self.owner, self.matrix = owner[order], np.ascontiguousarray(matrix[:, order]) if len(order) else matrix
        self.starts = np.searchsorted(self.owner, np.arange(len(languages)))
        self._forget()

    def _forget(self) -> None:
        """No word and no sequence met; a word's row in the tables is its number in `words`."""
        self.words: dict[str, int] = {}
        self.met: dict[str, list[tuple[int, list[str], float, float]]] = {}
        self._tables(0)

    def _tables(self, room: int) -> None:
        shapes = {"dots": (np.float32, len(self.owner)), "bys": (np.float32, len(self.languages)), "gains": (np.float32, len(self.languages))}
        tables = {name: np.zeros((room, width), kind) for name, (kind, width) in shapes.items()}
        tables |= {"tops": np.zeros(room, np.float32), "squares": np.zeros(room)}
        for name, table in tables.items():
            table[: len(self.words)] = getattr(self, name)[: len(self.words)] if self.words else 0
            setattr(self, name, table)

    def __getstate__(self):
        made = {"words", "met", "dots", "bys", "gains", "tops", "squares"}
        return {k: v for k, v in self.__dict__.items() if k not in made}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _row(self, word: str) -> int:
        """The word's row: dot products with the centroids, cosine by language, squared length; zeros for a name."""
        row = self.words.get(word)
        if row is None:
            name = word[:1] == "\u0001"
            bare = word[1:] if name else word
            dot, square = np.zeros(len(self.owner), np.float32), 0.0
            if bare in self.known or not name:
                ids = [self.vocab[f] for f in features(bare) if f in self.vocab]
                if ids:
                    weights = self.idf[ids]
                    dot = weights @ self.matrix[ids]
                    square = float(weights @ weights)
            by = np.maximum(np.maximum.reduceat(dot, self.starts), 0) / (square**0.5 or 1.0)
            row = len(self.words)
            if row == len(self.tops):
                self._tables(max(1024, 2 * row))
            self.dots[row], self.bys[row], self.squares[row] = dot, by, square
            # a word's evidence: its lag behind the best language, weighed by how clear the word is at all
            self.tops[row] = top = by.max(initial=0)
            self.gains[row] = (by - top) / np.maximum(top, 0.05)
            self.words[word] = row
        return row

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of words, good until the next call."""
        if len(self.words) > KEPT_WORDS:
            self.words = {}
            self._tables(0)
        return np.array([self._row(w) for w in words], np.int64)

    def nearest(self, words: list[str]) -> tuple[int, float, float]:
        """Language of the nearest centroid, its cosine, and its lead over the next language (0 to 1)."""
        rows = self._rows(words)
        square = sum(self.squares[rows].tolist())
        if not square:
            return 0, 0.0, 0.0
        dot = np.add.reduce(self.dots[rows])
        by = np.maximum(np.maximum.reduceat(dot, self.starts), 0) / square**0.5
        best = int(by.argmax())
        top = float(by[best])
        by[best] = 0
        return best, top, (top - float(by.max())) / top if top > 0 else 0.0

    def runs(self, words: list[str]) -> list[tuple[int, list[str], float, float]]:
        """Runs of one language: (language, words, cosine, lead)."""
        return self.runs_of([words])[0]

    def runs_of(self, sequences: list[list[str]]) -> list[list[tuple[int, list[str], float, float]]]:
        """runs() of every word sequence; kept for those met before, and new ones are compared many at once."""
        if len(self.met) > KEPT_RUNS:
            self.met.clear()
        keys = [" ".join(words) for words in sequences]
        new = {key: words for key, words in zip(keys, sequences, strict=True) if key not in self.met}
        some: dict[str, list[str]] = {}
        size = 0
        for key, words in new.items():
            if len(words) > TOGETHER:
                self.met[key] = self._runs(words)
                continue
            some[key] = words
            size += len(words)
            if size >= AT_ONCE:
                self.met.update(zip(some, self._together(list(some.values())), strict=True))
                some, size = {}, 0
        self.met.update(zip(some, self._together(list(some.values())), strict=True))
        return [self.met[key] for key in keys]

    def _together(self, sequences: list[list[str]]) -> list[list[tuple[int, list[str], float, float]]]:
        """_runs() of sequences, those of one language all at once: word by word, so sums are the same as of each alone."""
        count = len(sequences)
        out: list[list[tuple[int, list[str], float, float]]] = [[] for _ in sequences]
        if not any(sequences) or not self.languages:
            return out
        rows = self._rows([w for words in sequences for w in words])
        at = np.repeat(np.arange(count), [len(words) for words in sequences])
        keep = self.tops[rows] > 0
        rows, at = rows[keep], at[keep]
        sizes = np.bincount(at, minlength=count)
        order = np.argsort(-sizes, kind="stable")
        longer = np.cumsum(np.bincount(sizes)[::-1])[::-1]  # sequences of so many words or more
        first = (np.cumsum(sizes) - sizes)[order]
        dot = np.zeros((count, len(self.owner)), np.float32)
        total = np.zeros((count, len(self.languages)), np.float32)
        square = np.zeros(count)
        for j, n in enumerate(longer[1:].tolist()):
            word = rows[first[:n] + j]
            dot[:n] += self.dots[word]
            total[:n] += self.gains[word]
            square[:n] += self.squares[word]
        by = np.maximum(np.maximum.reduceat(dot, self.starts, axis=1), 0) / np.maximum(np.sqrt(square), 1e-30).astype(np.float32)[:, None]
        best = by.argmax(axis=1)
        top = by[np.arange(count), best].astype(float)
        by[np.arange(count), best] = 0
        lead = np.divide(top - by.max(axis=1), top, out=np.zeros(count), where=top > 0)
        one = total.max(axis=1).astype(float) > -SWITCH
        ends = np.cumsum([len(words) for words in sequences])
        for i, n, alone, *found in zip(*(x.tolist() for x in (order, sizes[order], ~one, best, top, lead)), strict=True):
            said = sequences[i]
            if n and alone:
                out[i] = self._runs(said)
            elif n:
                if n < len(said):
                    said = [w for w, k in zip(said, keep[ends[i] - len(said) : ends[i]].tolist(), strict=True) if k]
                out[i] = [(found[0], said, found[1], found[2])]
        return out

    def _runs(self, words: list[str]) -> list[tuple[int, list[str], float, float]]:
        if not words or not self.languages:
            return []
        rows = self._rows(words)
        keep = self.tops[rows] > 0
        if not keep.any():
            return []
        gain = self.gains[rows[keep]]
        said = [w for w, k in zip(words, keep, strict=True) if k]
        n, m = gain.shape
        total = gain.sum(axis=0)
        score = gain[0].copy()
        back = np.zeros((n, m), np.int32)
        if float(total.max()) > -SWITCH:  # one language explains it better than any change could
            path = [int(total.argmax())] * n
        else:
            stay = np.arange(m)
            for i in range(1, n):
                j = int(score.argmax())
                jump = score[j] - SWITCH
                change = score < jump
                back[i] = np.where(change, j, stay)
                score = np.where(change, jump, score) + gain[i]
            path = [int(score.argmax())]
            for i in range(n - 1, 0, -1):
                path.append(int(back[i][path[-1]]))
            path.reverse()
        out, at = [], 0
        for i in range(1, n + 1):
            if i == n or path[i] != path[at]:
                best, cosine, lead = self.nearest(said[at:i])
                out.append((best if i - at >= MIN_RUN or i - at == n else path[at], said[at:i], cosine, lead))
                at = i
        return out


def fit(samples: list[tuple[str, str, float]], centroids: int = CENTROIDS, rounds: int = 6, seed: int = 7) -> Centroids:
    """Centroids from (label, text, weight) rows; weight is the number of rows a row stands for. Wrong labels are outvoted in their clusters."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, Counter]] = []
    weights: list[float] = []
    spread: Counter = Counter()
    known: Counter = Counter()
    for label, text, weight in samples:
        code = code_of(label)
        words = [w for w in spoken_words(text) if w[:1] != "\u0001"]
        for k in range(0, len(words), 25):
            part = words[k : k + 25]
            if code and (len(part) >= 5 or k == 0) and part:
                counts = Counter(f for w in part for f in features(w))
                rows.append((code, counts))
                weights.append(weight)
                spread.update(counts.keys())
                known.update(set(part))
    if not rows:
        return Centroids([], np.zeros(0, int), {}, np.zeros(0), np.zeros((0, 0)), frozenset())
    vocab = {f: k for k, (f, n) in enumerate(sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:FEATURES]) if n > 1 or len(rows) < 50}
    labels = np.array([c for c, _ in rows])
    # a whole word says more than the letters it shares with related languages, and a feature of many languages little
    names = sorted(set(labels.tolist()))
    share = np.full((len(vocab), len(names)), 1e-6)
    for code, counts in rows:
        share[[vocab[f] for f in counts if f in vocab], names.index(code)] += 1.0
    share /= np.array([max(1, int((labels == c).sum())) for c in names])[None, :]
    share /= share.sum(axis=1, keepdims=True)
    clear = 1 + (share * np.log(share)).sum(axis=1) / np.log(max(2, len(names)))
    whole = np.array([WORD_WEIGHT if f[:2] == "w:" else 1.0 for f in vocab])
    idf = np.array([np.log((1 + len(rows)) / (1 + spread[f])) + 0.1 for f in vocab])
    idf = (idf * whole * (0.1 + clear)).astype(np.float32)
    index, data, ptr = [], [], [0]
    for _, counts in rows:
        got = [(vocab[f], n) for f, n in counts.items() if f in vocab]
        ids = np.array([i for i, _ in got], np.int64)
        values = np.sqrt(np.array([n for _, n in got], np.float32)) * idf[ids] if got else np.zeros(0, np.float32)
        norm = float(np.sqrt((values**2).sum())) or 1.0
        index.append(ids)
        data.append(values / norm)
        ptr.append(ptr[-1] + len(ids))
    start = []
    for code in sorted(set(labels)):
        own = np.flatnonzero(labels == code)
        for part in np.array_split(rng.permutation(own), min(centroids, len(own))):
            start.append(part)
    matrix = np.zeros((len(vocab), len(start)), np.float32)
    for c, part in enumerate(start):
        for r in part:
            matrix[index[r], c] += data[r]
    matrix /= np.maximum(np.sqrt((matrix**2).sum(axis=0)), 1e-9)
    at = np.zeros(len(rows), int)
    for _ in range(rounds):
        for r in range(len(rows)):
            at[r] = int((data[r] @ matrix[index[r]]).argmax()) if len(index[r]) else 0
        matrix[:] = 0
        for r in range(len(rows)):
            matrix[index[r], at[r]] += data[r]
        matrix /= np.maximum(np.sqrt((matrix**2).sum(axis=0)), 1e-9)
    votes: dict[int, Counter] = defaultdict(Counter)
    sizes = Counter(labels)
    for r in range(len(rows)):
        votes[at[r]][labels[r]] += weights[r]
    owners = {c: max(v.items(), key=lambda x: (x[1], sizes[x[0]], x[0]))[0] for c, v in votes.items()}
    # a language is one whose own texts mostly lie in clusters that it owns; other labels are wrong ones
    home = Counter(labels[r] for r in range(len(rows)) if owners[at[r]] == labels[r])
    real = sorted(str(c) for c in sizes if home[c] > 0.5 * sizes[c])
    # a centroid between languages, of mixed or wrongly labelled texts, would draw both: only clear ones stay
    members = Counter(at.tolist())
    clear = {c for c, v in votes.items() if v[owners[c]] >= PURITY * sum(v.values()) and members[c] >= 2}
    best = {code: max((c for c in owners if owners[c] == code), key=lambda c: votes[c][code]) for code in real if code in owners.values()}
    real = [code for code in real if code in best]
    good = [c for c in sorted(owners) if owners[c] in real and (c in clear or c == best[owners[c]])]
    owner = np.array([real.index(owners[c]) for c in good])
    return Centroids(real, owner, vocab, idf, np.ascontiguousarray(matrix[:, good]), frozenset(w for w, n in known.items() if n > 1))


def _code(label: str) -> Column:
    """The two-letter code of a column of labels, as code_of() has it."""
    base = F.lower(F.element_at(F.split(F.trim(label), r"[-_\s(]", 2), 1))
    return F.coalesce(*[F.when(base.isin(names.split()), F.lit(c)) for c, names in LANGUAGE_NAMES.items()])


def model(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Centroids:
    """Centroids fitted on about `per_label` documents of each language labelled, in whatever notation, whole texts."""
    labelled = documents.where("length(text) > 0").select("doc_id", _code("lang").alias("lang"), "text").where("lang is not null")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / per_label))
    counts = labelled.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    sample = labelled.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), every) == 0)
    sample = sample.groupBy("lang", "doc_id", every.cast("double").alias("weight")).agg(F.min("text").alias("text"))
    rows = sample.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()
    return fit([(r.lang, r.text, r.weight) for r in rows])


def _detect(shared, texts: bool):
    """Batches of (video_id, segment_index, text, speakers as one string) to batches of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: Centroids = shared.value
        codes = [str(c) for c in centroids.languages]
        for batch in batches:
            videos, indexes, langs, words, confidence, said_texts = [], [], [], [], [], []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            heard = []
            for text, credits in zip(*columns[2:], strict=True):
                parts = cut_segment(text, _speakers(credits))
                spoken_text = parts[0][1] if len(parts) == 1 else " ".join(p for _, p in parts)
                heard.append(spoken_words(spoken_text))
            for video, index, spoken_runs in zip(columns[0], columns[1], centroids.runs_of(heard), strict=True):
                for best, said, cosine, lead in spoken_runs:
                    if cosine >= MIN_COSINE:
                        videos.append(video)
                        indexes.append(index)
                        langs.append(codes[best])
                        words.append(len(said))
                        confidence.append(round(min(1.0, 0.5 + lead), 4))
                        said_texts.append(" ".join(said).replace("\u0001", "") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(videos, pa.string()), pa.array(indexes, pa.int32()), pa.array(langs, pa.string()), pa.array(words, pa.int32()),
                 pa.array(confidence, pa.float64()), pa.array(said_texts, pa.string())],
                ["video_id", "segment_index", "lang", "words", "confidence", "text"],
            )

    return run


@lru_cache(maxsize=50_000)
def _speakers(credits: str | None) -> tuple[str, ...]:
    return tuple(credits.split("\u0001")) if credits else ()


def segment_languages(videos: DataFrame, transcripts: DataFrame, documents: DataFrame, texts: bool = True) -> DataFrame:
    """Runs of one language in every segment: video_id, segment_index, lang, words, confidence, text (null unless `texts`)."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model(documents))
    who = current_videos(videos).select("video_id", F.array_join("speakers", "\u0001", "").alias("credits"))
    rows = transcripts.where("text is not null").groupBy("video_id", "segment_index").agg(F.min("text").alias("text")).join(who, "video_id", "left")
    return rows.mapInArrow(_detect(shared, texts), "video_id string, segment_index int, lang string, words int, confidence double, text string")


def spoken(runs: DataFrame) -> DataFrame:
    """Languages spoken in a segment: video_id, segment_index, lang, words, confidence; short runs beside longer ones don't count."""
    per = runs.groupBy("video_id", "segment_index", "lang").agg(F.sum("words").cast("int").alias("words"), F.max("confidence").alias("confidence"))
    most = F.max("words").over(Window.partitionBy("video_id", "segment_index"))
    return per.withColumn("most", most).where((F.col("words") >= MIN_RUN) | (F.col("words") == F.col("most"))).drop("most")


def main_language(said: DataFrame) -> DataFrame:
    """The language most segments of a video are spoken in: video_id, main, share (of its segments)."""
    n = said.groupBy("video_id", "lang").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    top = n.groupBy("video_id").agg(F.max(F.struct("n", "w", "lang")).alias("m"), F.sum("n").alias("all"))
    return top.select("video_id", F.col("m.lang").alias("main"), (F.col("m.n") / F.col("all")).alias("share"))


def video_languages(videos: DataFrame, transcripts: DataFrame, documents: DataFrame) -> DataFrame:
    """Every video with words: video_id, label (as given), labelled (code or null), lang, confidence."""
    main = main_language(spoken(segment_languages(videos, transcripts, documents, texts=False)))
    return _labels(videos).join(main, "video_id").select("video_id", "label", "labelled", F.col("main").alias("lang"), F.round("share", 4).alias("confidence"))


def _labels(videos: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("language"), F.coalesce("fetched_at", F.lit(0).cast("timestamp"))).alias("v")
    rows = videos.where("video_id is not null").groupBy("video_id").agg(last).select("video_id", F.col("v.language").alias("label"))
    return rows.withColumn("labelled", _code("label"))


def found(videos: DataFrame, transcripts: DataFrame, documents: DataFrame) -> DataFrame:
    """p2_found: videos with a missing or wrong label (segment_index -1) and the languages of segments not wholly in the main one."""
    from tidemark.session import materialize

    said = materialize(spoken(segment_languages(videos, transcripts, documents, texts=False)).select("video_id", "segment_index", "lang", "words"), "spoken")
    main = main_language(said)
    wrong = _labels(videos).join(main, "video_id").where(~F.col("labelled").eqNullSafe(F.col("main")))
    head = wrong.select("video_id", F.lit(-1).alias("segment_index"), F.col("main").alias("lang"))
    other = said.join(main.select("video_id", "main"), "video_id")
    odd = other.groupBy("video_id", "segment_index").agg(F.max(F.col("lang") != F.col("main")).alias("odd"), F.collect_set("lang").alias("langs")).where("odd")
    return head.unionByName(odd.select("video_id", "segment_index", F.explode("langs").alias("lang")))
