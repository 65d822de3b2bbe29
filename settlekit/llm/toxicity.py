"""Toxicity of whole texts: misspelled lexicon terms in context.

*Lexicon.* Learned from all labelled texts. A word is a term if texts that hold it are labelled
toxic far more often than texts are in general: the Chernoff bound on chance, over the number of
words frequent enough to pass at all, must be below `CHANCE`. A word's toxic texts count only by the distinct neighbours
(word before, word after) that they show it with, so a passage copied into many toxic texts
teaches nothing. Stems (the first `STEMS` letters of longer words) are counted like words, so
inflections and compounds that are sparse by themselves are known together; a stem that one word
makes up is no term, and a word that its stem explains (`EXPLAINED`) is left to it. Words and stems
that pass only at `SPARSE` get a weight as much smaller as their evidence is. These and stems are
matched letter by letter.

*Misspellings.* The terms form a trie. Intersected with the Levenshtein automaton of each term
(`edits`: none for terms under 5 letters, 1 under 9, else 2) it is a non-deterministic automaton
over (trie node, edits so far); its deterministic states are made when first met. A word is run
through it letter by letter and dropped when no state is left, mostly after a few letters. All
labelled words that come near a term are counted too: one found in clean texts is a word of
its own and no hit, and a term whose neighbours are often clean is matched exactly only.

*Context.* Each hit is weighed in a window of `WINDOW` words on both sides: inside quotation
marks, or after a word that reports speech, it is quoted; a word that addresses the reader or
another hit nearby makes it heavier. A text's evidence is the sum over its terms of their heaviest
unquoted hit, plus `QUOTED` of its heaviest quoted hit alone; the score is the logistic of the
evidence above a threshold, the one that errs least over a sample of the labels, at most about
`SAMPLE_TOXIC` and `SAMPLE_CLEAN` by the hash of their id (each class weighted to its share of all).

Texts are assessed whole, in one pass without a shuffle; labelled texts are found by a broadcast of
their ids, or a shuffle if these are many (`BROADCAST_LABELS`). Edge cases: a null or empty text, or one
without terms, has no evidence and a score below 0.5, as has every text if no lexicon could be
learned; labels that repeat an id count once, toxic if any says so; null labels are ignored;
repeated rows are separate rows; an empty table gives an empty result. `assess` keeps the columns
named in `keep`, and its own columns replace kept ones of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import exp, log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import held

SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 9000
CHANCE, SPARSE = 0.05, 1.0
STEMS = (4, 5, 6)
EXPLAINED = 2 / 3
BROADCAST_LABELS = 1_000_000
#: Words and stems that a task counts before it hands them on.
COUNT_KEYS = 300_000
LEAST_PRECISION = 0.7
WINDOW = 6
QUOTED = 0.2
NEAR, ADDRESSED = 1.25, 1.25
#: Evidence of a text without any hit; the weight of an unseen misspelling, as a share.
ABSENT, UNSEEN = -2.0, 0.7
CACHE_WORDS = 300_000
CACHE_STEPS = 300_000

# Words that report speech, and words that address the reader.
REPORTS = frozenset(
    "said says say saying wrote writes called calls quote quoted quotes quoting word words term terms slur slurs insult insults"
    " sagte sagt schrieb nannte wort dit disait appelle mot dijo dice llama palabra".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous ton ta tes tú ti usted".split())
#: Opening and closing quotation marks.
MARKS = (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"), ("‹", "›"), ("「", "」"))

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of terms and its Levenshtein automaton; `match(word)` gives the nearest term and
    its distance (ties: the term that sorts first), or None."""

    def __init__(self, terms: Sequence[str]) -> None:
        self.terms = sorted(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.allowed: list[int] = [0]  # the most edits that a term below a node allows
        for i, term in enumerate(self.terms):
            node = 0
            for c in term:
                self.allowed[node] = max(self.allowed[node], edits(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], edits(term))
            self.ends[node] = i
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.held = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a deterministic state; `nodes` has the least edits by trie node."""
        todo = list(nodes.items())
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= edits(self.terms[self.ends[n]])]
            self.found.append(min(ends) if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e if letter == c else e + 1
                if cost <= self.allowed[child] and cost < after.get(child, 99):
                    after[child] = cost
            if e + 1 <= self.allowed[node] and e + 1 < after.get(node, 99):  # a letter too many
                after[node] = e + 1
        to = self._state(after)
        self.steps[state][c] = to
        self.held += 1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if self.held > CACHE_STEPS:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        best = self.found[state]
        return (self.terms[best[1]], best[0]) if best else None


class Model:
    """Terms with weights, known words near them, minus the threshold of evidence, and the weights
    of what is matched exactly: sparse words, and stems (ending in `*`)."""

    def __init__(
        self, prior: float, weights: dict[str, float], unseen: dict[str, float], known: dict[str, float], exact: dict[str, float] | None = None
    ) -> None:
        self.prior, self.weights, self.unseen, self.known, self.exact = prior, weights, unseen, known, exact or {}
        parts = (weights, unseen, known, self.exact)
        self.key = xxhash.xxh3_64_hexdigest(repr((prior, *(sorted(x.items()) for x in parts))))


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def stem_of(word: str, exact: dict[str, float]) -> str | None:
    """The heaviest stem of a word among `exact`, the shortest of these."""
    return max((x for x in stems(word) if x in exact), key=lambda x: exact[x], default=None)


class Scorer:
    """A model in a worker, with the words met so far that are no hits."""

    def __init__(self, model: Model) -> None:
        self.model, self.lexicon = model, Lexicon(list(model.weights))
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    @classmethod
    def of(cls, model: Model) -> "Scorer":
        return held(f"toxicity {model.key}", lambda: cls(model))

    def _weigh(self, word: str) -> tuple[str, float] | None:
        found = self.lexicon.match(word)
        if found:
            term, distance = found
            if not distance:
                return term, self.model.weights[term]
            weight = self.model.known.get(word, self.model.unseen.get(term, 0.0))
            if weight > 0:
                return term, weight
        if word in self.model.exact:
            return word, self.model.exact[word]
        stem = stem_of(word, self.model.exact)
        if stem:
            weight = min(self.model.known.get(word, self.model.exact[stem]), self.model.exact[stem])
            return (stem, weight) if weight > 0 else None
        return None

    def score(self, text: str | None) -> tuple[float, int, int]:
        """Score, hits, and how many of them are quoted."""
        evidence, hits, quoted = self.evidence(text)
        return _logistic(self.model.prior + evidence), hits, quoted

    def evidence(self, text: str | None) -> tuple[float, int, int]:
        if not text or not (self.model.weights or self.model.exact):
            return ABSENT, 0, 0
        lower = text.lower()
        distinct = set(_WORD.findall(lower))
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        here: dict[str, tuple[str, float]] = {}
        for w in distinct - self.clean:
            hit = self.hits.get(w)
            if hit is None:
                hit = self._weigh(w)
                if hit is None:
                    self.clean.add(w)
                    continue
                self.hits[w] = hit
            here[w] = hit
        if not here:
            return ABSENT, 0, 0
        return self._in_context(lower, here)

    def _in_context(self, lower: str, here: dict[str, tuple[str, float]]) -> tuple[float, int, int]:
        plain: dict[str, float] = {}
        quoted, hits, quotes = 0.0, 0, 0
        for m in _WORD.finditer(lower):
            hit = here.get(m[0])
            if hit is None:
                continue
            term, weight = hit
            left, right = _before(lower, m.start()), _after(lower, m.end())
            around = [*_WORD.findall(left), *_WORD.findall(right)]
            weight *= NEAR if any(w in here for w in around) else 1.0
            weight *= ADDRESSED if not YOU.isdisjoint(around) else 1.0
            hits += 1
            if is_quoted(lower, m.start(), left, right):
                quotes += 1
                quoted = max(quoted, weight)
            else:
                plain[term] = max(plain.get(term, 0.0), weight)
        return sum(plain.values()) + QUOTED * quoted, hits, quotes


def _before(text: str, at: int) -> str:
    """The last WINDOW words before a place, on its line."""
    part = text[max(0, at - 40 * WINDOW) : at].rpartition("\n")[2]
    starts = [m.start() for m in _WORD.finditer(part)]
    # a mark right before the first word belongs to it
    return part if len(starts) <= WINDOW else part[max(0, starts[-WINDOW] - 1) :]


def _after(text: str, at: int) -> str:
    part = text[at : at + 40 * WINDOW].partition("\n")[0]
    ends = [m.end() for m in _WORD.finditer(part)]
    return part if len(ends) <= WINDOW else part[: ends[WINDOW - 1] + 1]


def is_quoted(text: str, at: int, left: str, right: str) -> bool:
    """Whether a hit with these windows stands in quotation marks or after a reporting word."""
    for opening, closing in MARKS:
        end = right.find(closing)
        if end >= 0 and left.rfind(opening) > left.rfind(closing) and opening not in right[:end]:
            return True
    if '"' in right and '"' in left:
        line = text.rfind("\n", 0, at) + 1
        if text.count('"', line, at) % 2:
            return True
    return not REPORTS.isdisjoint(_WORD.findall(left)[-3:])


def _logistic(x: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return log((toxic + 0.5) / (n_toxic + 1)) - log((clean + 0.5) / (n_clean + 1))


def _unlikely(k: int, clean: int, base: float) -> float:
    """The Chernoff exponent of k toxic texts out of k + clean, by chance `base` each."""
    n = k + clean
    p = k / n
    if p <= base:
        return 0.0
    return n * (p * log(p / base) + (0.0 if p >= 1 else (1 - p) * log((1 - p) / (1 - base))))


def least_exponent(frequent: Sequence[int], base: float, chance: float) -> float:
    """The Chernoff exponent that less than `chance` of all words reach by chance. `frequent[i]` is
    how many words are in more than i texts; a word in too few to reach it even if all are toxic
    is not a test."""
    for i, words_ in enumerate(frequent):
        if words_ * base ** (i + 1) <= chance:
            break
    return log(max(words_, 1) / chance)


def threshold(found: Sequence[tuple[float, bool]], toxic_weight: float, clean_weight: float) -> float:
    """The evidence from which a text is called toxic, at the least weighted error over (evidence,
    toxic) pairs: the middle of the widest gap between evidences where that error is reached."""
    order = sorted(found)
    error = sum(clean_weight for _, toxic in order if not toxic)  # all called toxic
    best, choice = (float("inf"), 0.0), 1.0
    for i, (x, toxic) in enumerate(order):
        error += toxic_weight if toxic else -clean_weight
        after = order[i + 1][0] if i + 1 < len(order) else x + 2
        if after > x and after > 0 and (error, x - after) < best:
            best, choice = (error, x - after), (max(x, 0.0) + after) / 2
    return choice


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from `docs` (doc_id, text) and those rows of `labels` (doc_id, toxic) where
    `usable`, a condition on doc_id, holds."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    given = given.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    numbers = {r[0]: r[1] for r in given.groupBy("toxic").count().collect()}
    n_toxic, n_clean = numbers.get(True, 0), numbers.get(False, 0)
    prior = log((n_toxic + 1) / (n_clean + 1))
    nothing = Model(min(prior, 0.0), {}, {}, {})
    if not n_toxic or not n_clean:
        return nothing
    span = 1 << 20
    rate = F.when(F.col("toxic"), max(1, min(span, span * SAMPLE_TOXIC // n_toxic))).otherwise(max(1, min(span, span * SAMPLE_CLEAN // n_clean)))
    chosen = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < rate)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def labelled(rows: DataFrame, n: int) -> DataFrame:
        return texts.join(F.broadcast(rows) if n <= BROADCAST_LABELS else rows, "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})  # of clean texts, of toxic texts

        def counted() -> Iterator[pa.RecordBatch]:
            clean, toxic = counts
            names = list({**toxic, **clean})
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), *(pa.array([c.get(w, 0) for w in part], pa.int64()) for c in (toxic, clean))],
                    names=["word", "toxic", "clean"],
                )
            clean.clear()
            toxic.clear()

        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, keys = counts[label], set(words(t))
                # the number of texts is the row of the empty word
                for w in keys.union(*map(stems, keys), [""]):
                    own[w] = own.get(w, 0) + 1
                if len(counts[0]) + len(counts[1]) > COUNT_KEYS:
                    yield from counted()
        yield from counted()

    counted = labelled(given, n_toxic + n_clean).mapInArrow(count, "word string, toxic long, clean long")
    vocabulary = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    try:
        in_toxic, in_clean = vocabulary.filter("word = ''").agg(F.sum("toxic"), F.sum("clean")).first()
        if not in_toxic or not in_clean:
            return nothing
        base = in_toxic / (in_toxic + in_clean)
        # the rows of the words in one text, two texts, ...; all others in the last
        most = 200
        sizes = dict(vocabulary.filter("word != ''").groupBy(F.least(F.col("toxic") + F.col("clean"), F.lit(most)).alias("n")).count().collect())
        frequent = [sum(v for n, v in sizes.items() if n > i) for i in range(most)]
        least, sparse = least_exponent(frequent, base, CHANCE), least_exponent(frequent, base, SPARSE)
        n = F.col("toxic") + F.col("clean")
        p = F.col("toxic") / n
        chance = n * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
        likely = (F.col("word") != "") & (F.col("toxic") >= 3) & (p >= LEAST_PRECISION) & (p > base) & (chance > sparse * (1 - 1e-9))
        candidates = {r[0]: (r[1], r[2]) for r in vocabulary.filter(likely).collect()}
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

        def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = wanted.value
            for batch in batches:
                for t in batch.column(1).to_pylist():
                    found = words(t)
                    padded = ["", *found, ""]
                    rows = {
                        (key, xxhash.xxh3_64_intdigest(f"{padded[i]} {padded[i + 2]}") - (1 << 63))
                        for i, w in enumerate(found) for key in (w, *stems(w)) if key in mine
                    }
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["word", "around"])

        shown = labelled(given.filter("toxic"), n_toxic).mapInArrow(neighbours, "word string, around long")
        shown = dict(shown.distinct().groupBy("word").count().collect()) if candidates else {}
        # toxic texts (by their neighbours), clean texts and evidence of each word and stem
        passed = {}
        for word, (toxic, clean) in candidates.items():
            k = min(toxic, shown.get(word, 0))
            if k >= 3 and k / (k + clean) >= LEAST_PRECISION and (found := _unlikely(k, clean, base)) > sparse:
                passed[word] = k, clean, _log_odds(k, clean, in_toxic, in_clean) * min(1.0, found / least)
        # a stem that one word makes up is that word with its misspellings
        made_up = {x for w, (k, _, _) in passed.items() if w[-1] != "*" for x in stems(w) if x in passed and k > EXPLAINED * passed[x][0]}
        exact = {w: x[2] for w, x in passed.items() if w[-1] == "*" and w not in made_up}
        weights = {}
        for word, (k, clean, weight) in passed.items():
            if word[-1] == "*" or (stem := stem_of(word, exact)) and exact[stem] >= EXPLAINED * weight:
                continue
            (weights if _unlikely(k, clean, base) > least else exact)[word] = weight
        if not weights and not exact:
            return nothing
        lexicon = Lexicon(list(weights))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for w, t, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if not w or w[-1] == "*":
                        continue
                    found = lexicon.match(w)
                    if found and found[1]:
                        rows.append((w, found[0], t, c))
                    elif not found and c > t and stem_of(w, exact):
                        rows.append((w, None, t, c))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["word", "term", "toxic", "clean"])

        variants = vocabulary.select("word", "toxic", "clean").mapInArrow(near, "word string, term string, toxic long, clean long").collect()
    finally:
        vocabulary.unpersist()
    known, total = {}, {}
    for word, term, toxic, clean in variants:
        odds = _log_odds(toxic, clean, in_toxic, in_clean)
        known[word] = odds if odds >= 2.0 and not clean else 0.0
        if term is None:
            continue
        sums = total.setdefault(term, [0, 0])
        sums[0], sums[1] = sums[0] + toxic, sums[1] + clean
    unseen = {}
    for term, weight in weights.items():
        toxic, clean = total.get(term, (0, 0))
        odds = _log_odds(toxic, clean, in_toxic, in_clean)
        unseen[term] = UNSEEN * weight if not clean else UNSEEN * min(weight, odds) if odds >= 2.0 else 0.0
    model = Model(0.0, weights, unseen, known, exact)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.evidence(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(0)], names=["evidence", "toxic"])

    # a row for each text of the sample, whose ids are few
    sample = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    found = [tuple(r) for r in sample.mapInArrow(weigh, "evidence double, toxic boolean").collect()]
    toxic = sum(label for _, label in found)
    shares = n_toxic / max(1, toxic), n_clean / max(1, len(found) - toxic)
    return Model(-threshold(found, *shares), weights, unseen, known, exact)


def assess(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of `docs`, score, predicted (1 if score >= 0.5), hits and quoted."""
    own = ("score", "predicted", "hits", "quoted")
    kept = [c for c in keep if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [scorer.score(t) for t in part.column(len(kept)).to_pylist()]
                made = [
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([int(r[0] >= 0.5) for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *made], names=[*kept, *own])

    rows = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    return rows.mapInArrow(run, schema + "score double, predicted int, hits int, quoted int")
