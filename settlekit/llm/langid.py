"""Language identification of mixed-language text.

*Model.* Learned from labelled texts: for each language the frequencies of character trigrams
(with word borders) over its words, and of letters by script. The labelled texts are a
sample: at most about `SAMPLE_DOCS` distinct ones per language, chosen by the hash of the text. Their trigrams are
counted in the tasks and summed by a shuffle; those seen `LEAST_COUNT` times reach the driver.

*Words.* A word is a run of letters, in lower case. The script of its first letter narrows the
candidates to the languages that write a fair share (`SCRIPT_SHARE`) of their letters in it (all,
if none does); a candidate's score is the log-probability of the word's trigrams, the others' is far
below.

*Spans.* The best path through a text's words (Viterbi) pays `SWITCH` for each change of language,
so a foreign word or two stay in their surroundings and a foreign passage becomes a span. The
text's language is that of most letters on the path. The score is its share, weighted by how clearly the path's words prefer their language. Paths of all texts of a batch are found together, one
vectorised step per word place.

Texts are used whole and never shuffled; a worker keeps scores of a bounded number of words.

Edge cases: a null text, or one without a letter, is `und` with score 0 and no spans, as is every
text if nothing could be learned; ties go to the language that sorts first; repeated rows are
separate rows; an empty table gives an empty result. `identify` keeps the columns named in `keep`,
and its own columns replace kept ones of the same name.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import held

UNKNOWN = "und"
SAMPLE_DOCS = 1500
LEAST_COUNT = 3
SCRIPT_SHARE = 0.01
SWITCH = 12.0
SMOOTHING = 0.5
#: Log-probability of a word in a language that is not among its candidates.
EXCLUDED = -200.0
CACHE_WORDS = 250_000
BATCH_WORDS = 1_000_000

# Where scripts begin (code points); the last one ends the previous.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7FC, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x40000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case; there are some if `has_letter`."""
    found = _WORD.findall((text or "").lower())
    if (text or "").isascii() or all(map(str.isalpha, found)):
        return found
    # a superscript, circled digit or letter numeral is no letter and parts the run
    return [part for w in found for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def script(word: str) -> str:
    return SCRIPTS[max(0, int(np.searchsorted(_STARTS, ord(word[0]), side="right")) - 1)][1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(word))]


class Model:
    """Languages, n-gram log-probabilities (a row each), scripts' candidates."""

    def __init__(self, counts: Sequence[tuple[str, str, str, int]]) -> None:
        """counts: (language, kind, key, n); kind is `gram` or `script`."""
        self.languages = sorted({c[0] for c in counts})
        at = {x: i for i, x in enumerate(self.languages)}
        size = len(self.languages)
        table: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for language, kind, key, n in sorted(counts):
            rows = table if kind == "gram" else letters
            rows.setdefault(key, np.zeros(size))[at[language]] += n
        self.index = {g: i for i, g in enumerate(table)}
        self.unknown = len(self.index)
        count = np.array([*table.values(), np.zeros(size)]).reshape(len(table) + 1, size)
        total = count.sum(axis=0) + SMOOTHING * len(count)
        self.logs = np.log((count + SMOOTHING) / total).astype(np.float32)
        # a trigram that was never seen says nothing for or against a language
        self.logs[-1] = self.logs.min(initial=0.0)
        share = {s: n / np.maximum(1, sum(letters.values())) for s, n in letters.items()}
        #: Which languages a script leaves, for scripts that leave out some.
        self.candidates = {s: x >= SCRIPT_SHARE for s, x in share.items() if (x >= SCRIPT_SHARE).any() and not (x >= SCRIPT_SHARE).all()}
        self.narrow: dict[str, np.ndarray | None] = {}
        self.key = xxhash.xxh3_64_hexdigest(repr(sorted(counts)))

    def scores(self, new: list[str]) -> np.ndarray:
        """Scores of words, a row each, by language; 0 is the best language of the word."""
        index, unknown = self.index, self.unknown
        flat: list[int] = []
        ends: list[int] = []
        for w in new:
            flat.extend([index.get(g, unknown) for g in grams(w)])
            ends.append(len(flat))
        starts = np.array([0, *ends[:-1]])
        sums = np.add.reduceat(self.logs[np.array(flat)], starts, axis=0)
        sums -= sums.max(axis=1, keepdims=True)
        if self.candidates:
            for i, w in enumerate(new):
                if w[0] not in self.narrow:
                    self.narrow[w[0]] = self.candidates.get(script(w))
                fit = self.narrow[w[0]]
                if fit is not None:
                    sums[i][~fit] = EXCLUDED
        return sums


class Scorer:
    """A model with the scores of words met so far, per worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    @classmethod
    def of(cls, model: Model) -> "Scorer":
        return held(f"langid {model.key}", lambda: cls(model))

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)), dtype=np.float32)
        self.held = 0

    def look_up(self, found: list[list[str]]) -> np.ndarray:
        """Row numbers of all words of the texts, one after the other."""
        if self.held > CACHE_WORDS:
            self._clear()
        rows = self.rows
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in rows))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            scores = self.model.scores(part)
            if self.held + len(part) > len(self.table):
                grown = np.empty((max(2 * len(self.table), self.held + len(part)), scores.shape[1]), dtype=np.float32)
                grown[: self.held] = self.table[: self.held]
                self.table = grown
            self.table[self.held : self.held + len(part)] = scores
            rows.update(zip(part, range(self.held, self.held + len(part))))
            self.held += len(part)
        return np.fromiter((rows[w] for ws in found for w in ws), dtype=np.int64, count=sum(map(len, found)))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word. `scores` has the words of all texts one after the other;
    texts are worked on together, a place at a time. Ties stay in the language."""
    total, size = scores.shape
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.empty(0, int)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, lengths = starts[order], lengths[order]
    path = np.zeros(total, dtype=np.int16)
    if not len(order):
        return path
    # texts still going at each place: they are sorted by length
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    jump = np.zeros(total, dtype=np.int16)  # the best language of the word before
    stays = np.empty((total, size), dtype=bool)
    value = scores[starts].astype(np.float32)
    last = np.empty((len(order), size), dtype=np.float32)
    for t in range(1, int(lengths[0])):
        n = going[t]
        if n < len(value):
            last[n : len(value)] = value[n:]
            value = value[:n]
        at = starts[:n] + t
        top = value.argmax(axis=1)
        moved = value[np.arange(n), top][:, None] - switch
        stay = value >= moved
        jump[at] = top
        stays[at] = stay
        value = np.where(stay, value, moved) + scores[at]
    last[: len(value)] = value
    state = last.argmax(axis=1).astype(np.int16)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = going[t]
        at = starts[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = np.where(stays[at, state[:n]], state[:n], jump[at])
    return path


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the rows of `docs` where `usable` holds and text and language are not null."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    # one row for each language; copies of a text count once
    counts = {r[0]: r[1] for r in rows.select("l", "h").distinct().groupBy("l").count().collect()}
    if not counts:
        return Model([])
    span = 1 << 20
    limits = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, max(1, min(span, span * sample_docs // n)))])
    sample = rows.filter(F.pmod("h", F.lit(span)) < limits[F.col("l")])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of each group of copies that a task meets: no more rows than the sample has."""
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            mask = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                mask.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(mask, pa.bool_()))

    sample = sample.mapInArrow(first, "l string, t string, h long").dropDuplicates(["l", "h"]).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(l, Counter()).update(words(t))
        for l, seen in found.items():
            grams_, letters = Counter(), Counter()
            for w, n in seen.items():
                letters[script(w)] += n * len(w)
                for g in grams(w):
                    grams_[g] += n
            for kind, c in (("gram", grams_), ("script", letters)):
                if c:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([l] * len(c)), pa.array([kind] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())],
                        names=["lang", "kind", "key", "n"],
                    )

    summed = sample.mapInArrow(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in summed.filter((F.col("kind") == "script") | (F.col("n") >= LEAST_COUNT)).collect()])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), switch: float = SWITCH) -> DataFrame:
    """The `keep` columns of `docs`, lang_pred, score, and spans (first_word, words, lang)."""
    own = ("lang_pred", "score", "spans")
    kept = [c for c in keep if c not in own]
    languages = model.languages
    spans_type = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def label(texts: list[str | None], scorer: Scorer) -> list[pa.Array]:
        found = [words(t) for t in texts]
        lengths = np.array([len(w) for w in found], dtype=np.int64)
        number = scorer.look_up(found)
        table = scorer.table
        scores = table[number]
        path = viterbi(scores, lengths, switch)
        owner = np.repeat(np.arange(len(texts)), lengths)
        letters = np.fromiter((len(w) for ws in found for w in ws), dtype=np.float64, count=len(number))
        size = len(languages)
        by = np.bincount(owner * size + path, weights=letters, minlength=len(texts) * size).reshape(-1, size).astype(float)
        total = by.sum(axis=1)
        best = by.argmax(axis=1)
        # how far the words of the path are from their second best language, in 0 to 1
        mine = scores[np.arange(len(number)), path]
        others = scores.copy()
        others[np.arange(len(number)), path] = -np.inf
        gap = mine - (others.max(axis=1) if size > 1 else mine - 50.0)
        mean = np.bincount(owner, weights=np.clip(gap, -20, 50), minlength=len(texts)) / np.maximum(lengths, 1)
        score = by[np.arange(len(texts)), best] / np.maximum(total, 1) / (1 + np.exp(-np.clip(mean, -50, 50) * np.minimum(lengths, 20)))
        known = lengths > 0
        change = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(path, prepend=-1)) if len(number) else np.empty(0, np.int64)
        until = np.append(change[1:], len(number))
        first_of = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.bincount(owner[change], minlength=len(texts))
        names = np.array(languages, dtype=object)
        items = pa.StructArray.from_arrays(
            [pa.array(change - first_of[owner[change]], pa.int32()), pa.array(until - change, pa.int32()), pa.array(names[path[change]], pa.string())],
            names=["first_word", "words", "lang"],
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return [
            pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
            pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64()),
            pa.ListArray.from_arrays(offsets, items),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        most = max(1, BATCH_WORDS * 4 // max(4, len(languages))) * 6  # characters
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= most):
                    held += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                if languages:
                    made = label(part, scorer)
                else:
                    made = [pa.array([UNKNOWN] * len(part)), pa.array([0.0] * len(part)), pa.array([[]] * len(part), spans_type)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(len(kept))), *made], names=[*kept, *own])
                at = end

    rows = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    return rows.mapInArrow(run, schema + "lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>")
