"""Spelling variants: words that differ by one edit, grouped under the more frequent form.

*Words.* Runs of Latin letters (`A-Z a-z U+00C0-U+00FF`) of whole texts, `A-Z` in lower case. A
planted slip removes one code point of every 199th run, chosen by the crc32 of id and run. The
runs of a batch are found on the UTF-8 bytes with numpy and counted as (document, word) pairs; the
crc32 of a pair is put together from that of the id and that of the word, for a crc32 is linear
in its start value. A batch sends one row for each of its words. Words of at least `LEAST_LETTERS`
code points and `LEAST_COUNT` occurrences are kept.

*Near words* differ by exactly one inserted, deleted or replaced code point. Each word is a vector of
letter counts; a replacement moves it by a squared distance of 2, an insertion by 1. Words are
blocked by length and by how many of their letters fall into each of `GROUPS` classes of letters:
one edit leads to a block of equal or adjacent length that differs by one letter of one class, or
by one moved from a class to another. Large blocks are cut into parts of about `BLOCK` words. For
each two parts of such blocks one NumPy product of the letter-count matrices gives all squared
distances; pairs at most two apart (exactly one in adjacent lengths) are verified letter by letter.
Blocks travel, pairs are made inside a task, and only near pairs leave it: no block is ever
gathered in one task with all that it is compared with.

*Forms.* A word's form is its most frequent near word (ties: the smallest) if that has at least
`TIMES` times its occurrences. Counts grow by that factor along a chain of forms, so a chain has at
most log(2^63) / log(`TIMES`) steps and a fixed number of doublings follows it to its root.

Edge cases: null and empty texts have no words; a null id counts as an empty one; repeated rows
count each; an empty table gives an empty result; a word without near words has n_near 0, null
form and itself as root; extra columns are ignored. Text is read as UTF-8; other letters end a run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import saved

SLIP = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
#: Words in a part of a block, about.
BLOCK = 768
#: Classes of letters, by code point.
GROUPS = 5
#: Bytes of text that are worked on at a time.
BATCH_BYTES = 8 << 20
#: The longest run, in bytes, whose crc32 is put together by table.
TABLE_BYTES = 64

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are 0xC3 and a byte in UTF-8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_tables() -> np.ndarray:
    """By length, byte of the start value, and its value: the share of the start value in the
    crc32 of any data of that length."""
    found = np.zeros((TABLE_BYTES + 1, 4, 256), dtype=np.uint32)
    for length in range(TABLE_BYTES + 1):
        zeros = bytes(length)
        none = zlib.crc32(zeros, 0)
        for byte in range(4):
            found[length, byte] = [zlib.crc32(zeros, v << 8 * byte) ^ none for v in range(256)]
    return found


_TABLES: list[np.ndarray] = []


def pair_crcs(starts: np.ndarray, lengths: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """crc32(a + b) for crc32(a) in `starts`, and the length and crc32 of b (at most TABLE_BYTES)."""
    if not _TABLES:
        _TABLES.append(_crc_tables())
    t = _TABLES[0]
    out = crcs.copy()
    for byte in range(4):
        out ^= t[lengths, byte, (starts >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def runs(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct lower-case runs of `texts`, and the number of each run's text and word."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _LETTERS[whole]
    inside[1:] |= whole[:-1] == 0xC3
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(whole)]
    starts[borders] = inside[borders]  # a run ends with its text
    first = np.flatnonzero(starts)
    if not len(first):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    kept = np.flatnonzero(inside)
    ends = np.append(np.searchsorted(kept, first), len(kept)).astype(np.int32)
    letters = _LOWER[whole[kept]]
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return words.dictionary.to_pylist(), np.searchsorted(offsets, first, side="right") - 1, words.indices.to_numpy().astype(np.int64)


def slipped(ids: list[str], texts: pa.StringArray) -> dict[str, int]:
    """Occurrences of each word of the texts, with the planted slips."""
    words, text, word = runs(texts)
    if not words:
        return {}
    pairs, times = np.unique(text * len(words) + word, return_counts=True)
    text, word = np.divmod(pairs, len(words))
    heads = [f"{i}:".encode() for i in ids]
    starts = np.array([zlib.crc32(h) for h in heads], dtype=np.uint32)
    lengths = np.array([len(w) for w in words])
    crcs = pair_crcs(starts[text], np.minimum(lengths, TABLE_BYTES)[word], np.array([zlib.crc32(w) for w in words], dtype=np.uint32)[word])
    for i in np.flatnonzero(lengths[word] > TABLE_BYTES):
        crcs[i] = zlib.crc32(heads[text[i]] + words[word[i]])
    slips = np.flatnonzero(crcs % SLIP == 0)
    total = np.bincount(word, weights=times, minlength=len(words)).astype(np.int64)
    np.subtract.at(total, word[slips], times[slips])
    found = {w.decode("utf-8", "replace"): n for w, n in zip(words, total.tolist()) if n}
    for i in slips.tolist():
        run = words[word[i]].decode("utf-8", "replace")
        at = int(crcs[i]) % len(run)
        run = run[:at] + run[at + 1 :]
        found[run] = found.get(run, 0) + int(times[i])
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the kept words of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = batch.num_rows, 0
            mean = max(1, batch.nbytes // max(1, size))
            step = max(1, BATCH_BYTES // mean)
            while at < size:
                part = batch.slice(at, step)
                at += step
                found = slipped(part.column(0).to_pylist(), part.column(1))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
                    )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    counted = rows.mapInArrow(run, "word string, n long").filter(F.char_length("word") >= LEAST_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _classes() -> list[str]:
    """The letters of each class, as they stand in a pattern."""
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    return ["".join(c for c in letters if ord(c) % GROUPS == g) for g in range(GROUPS)]


def blocks(words: DataFrame) -> DataFrame:
    """(length, classes, part, members, counts): the words of each block's parts, parted by spaces."""
    of = F.array(*[F.char_length(F.regexp_replace("word", f"[^{c}]", "")) for c in _classes()])
    keyed = words.select("word", "n", F.char_length("word").alias("length"), of.alias("classes"))
    sizes = keyed.groupBy("length", "classes").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = keyed.join(sizes, ["length", "classes"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    member = F.collect_list(F.struct("word", "n"))
    return dealt.groupBy("length", "classes", "part").agg(member.alias("m")).select(
        "length",
        "classes",
        "part",
        F.concat_ws(" ", F.col("m")["word"]).alias("members"),
        F.col("m")["n"].alias("counts"),
    )


def _changed(classes: Column, *changes: tuple[int, int]) -> Column:
    return F.array(*[classes[g] + sum(by for at, by in changes if at == g) for g in range(GROUPS)])


def neighbours(length: Column, classes: Column) -> Column:
    """The blocks that a block is compared with, each two of them once."""
    same = [_changed(classes)] + [_changed(classes, (a, -1), (b, 1)) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
    longer = [_changed(classes, (g, 1)) for g in range(GROUPS)]
    return F.array(
        *[F.struct(length.alias("length"), c.alias("classes")) for c in same],
        *[F.struct((length + 1).alias("length"), c.alias("classes")) for c in longer],
    )


def _matrix(words: list[bytes]) -> np.ndarray:
    """The Latin-1 letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def _letter_counts(letters: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A row of letter counts for each row of letters, over the letters in use."""
    place = np.zeros(256, dtype=np.int64)
    place[used] = np.arange(len(used))
    flat = place[letters] + len(used) * np.arange(len(letters))[:, None]
    return np.bincount(flat.ravel(), minlength=letters.shape[0] * len(used)).reshape(-1, len(used)).astype(np.float32)


def near_pairs(left: list[bytes], right: list[bytes], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the near words of `left` (all of one length) and `right` (all of that length, or
    all of the next); `same` if the two are one list, of which each pair is found once."""
    a, b = _matrix(left), _matrix(right)
    used = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    x, y = _letter_counts(a, used), _letter_counts(b, used)
    apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    longer = b.shape[1] - a.shape[1]
    i, j = np.nonzero(apart <= (1.5 if longer else 2.5))
    if same:
        i, j = i[i < j], j[i < j]
    if not longer:
        good = (a[i] != b[j]).sum(1) == 1
    else:
        p, q = a[i], b[j]
        ahead = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
        behind = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
        good = ahead + behind >= a.shape[1]
    return i[good], j[good]


def near(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, for all near words of `words` (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                m, mc, o, oc, same = (batch.column(c)[r].as_py() for c in range(5))
                left, right = m.split(" "), o.split(" ")
                i, j = near_pairs([w.encode("latin-1") for w in left], [w.encode("latin-1") for w in right], same)
                if len(i):
                    a, b = [left[k] for k in i], [right[k] for k in j]
                    na, nb = [mc[k] for k in i], [oc[k] for k in j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(nb + na, pa.int64())],
                        names=["word", "near", "near_n"],
                    )

    parts = saved(blocks(words))
    left = parts.withColumn("to", F.explode(neighbours(F.col("length"), F.col("classes")))).select(
        F.col("to.length").alias("length"),
        F.col("to.classes").alias("classes"),
        F.col("members").alias("own"),
        F.col("counts").alias("own_n"),
        F.struct("length", "classes", "part").alias("at"),
    )
    right = parts.withColumn("here", F.struct("length", "classes", "part"))
    both = left.join(right, ["length", "classes"])
    mine = F.struct(F.col("at.length"), F.col("at.classes")) == F.struct(F.col("here.length"), F.col("here.classes"))
    both = both.filter(~mine | (F.col("at.part") <= F.col("part")))
    return both.select("own", "own_n", "members", "counts", F.col("at") == F.col("here")).mapInArrow(
        run, "word string, near string, near_n long"
    )


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each kept word of `docs` (doc_id, text)."""
    words = saved(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    around = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    found = saved(
        words.join(around, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # a chain has at most log(2^63) / log(TIMES) steps, and each round doubles those taken
    for _ in range(math.ceil(math.log2(63 / math.log2(TIMES)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = saved(roots.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
