"""Best-fit packing by a plan over the histogram of lengths.

*Pieces.* A document's ids (and the end id) are cut into pieces of `window` ids; only the first
piece is shorter. Each document is tokenised once, in the task that reads it; a piece's checksum,
its length and its rank among the task's pieces of that length are all that is kept, and are
saved. Token ids never travel.

*Plan.* There are at most `window` lengths, so their histogram has at most `window` rows whatever
the input; only it reaches the driver. Best fit decreasing runs over counts instead of documents:
all pieces of a length go at once, longest first, into the open sequences with the least room
that still take one, as many to a sequence as fit, then into new ones. Sequences of equal room are
kept as ranges of ids, so the plan is a list of runs: "ranks r to r + count of length s: `per` to a
sequence, from sequence q on, at offset o". A step splits at most one range, so the number of
runs depends on the lengths that occur and not on how many documents have them.

*Slots.* A piece's rank within its length is its rank in its task plus the number of such pieces
in earlier tasks (a window over one row for each length and task). It takes its slot by joining
the runs on its length and rank: a broadcast join with the plan's few rows, so a length that a
third of all pieces share is spread like any other.

Edge cases: null or empty text is the end id alone; a null doc_id stays null; repeated rows are
documents of their own; documents longer than `window` take whole sequences for all but their first
piece; a document of exactly `window` ids is one piece; an empty table gives an empty result; extra
columns are ignored. Sequence ids are 0, 1, ... without gaps; ties between equal lengths go by task
and by place in it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from settlekit.llm.common import held, saved
from settlekit.llm.packing import Kept, byte_symbols, known_characters

WINDOW = 2048
END = 0
#: Pre-tokens whose ids a worker keeps at a time.
CACHE_WORDS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
RUNS = "length long, first long, count long, per long, sequence long, at long"


class ByteTokenizer:
    """A byte-level BPE file, applied pre-token by pre-token.

    Its pre-tokenizer cuts a text into words, numbers, marks and white space, and no merge crosses a
    cut, so a text's ids are its pre-tokens' ids in a row and a pre-token's ids can be kept. The
    pattern of the file's pre-tokenizer is written out over the known characters; a text with any
    other character, or with a special token's name, goes through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters, numbers, known = known_characters()
        self.cut = re.compile(
            rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^ \t\n\r{letters}{numbers}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
        ).findall
        self.unknown = re.compile(rf"[^{known}]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbols = byte_symbols()
        self.cache = Kept(self._ids)

    def _ids(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if self.unknown(text) or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.cut(text)))

    @classmethod
    def load(cls, path: str) -> "ByteTokenizer":
        return held(f"bytes {path}", lambda: cls(path))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of each document, with the reading task (`part`) and the rank among the task's
    pieces of the same length (`place`)."""
    ending = np.array([end], dtype="<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteTokenizer.load(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, 64):  # texts become Python strings a few at a time
                few = batch.slice(at, 64)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    ids = words.encode(text or "") + ending
                    total = len(ids) // 4
                    begin, stop = 0, total % window or window
                    piece = 0
                    while begin < total:
                        length = stop - begin
                        rows.append((doc_id, piece, begin, length, zlib.crc32(ids[4 * begin : 4 * stop]), part, seen[length]))
                        seen[length] += 1
                        piece, begin, stop = piece + 1, stop, stop + window
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(histogram: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over `histogram` (count by length): runs (length, first rank, count,
    pieces to a sequence, first sequence, offset in it)."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by room left: (first sequence, how many)
    runs, opened = [], 0
    for s in sorted((s for s, n in histogram.items() if n), reverse=True):
        left, rank = histogram[s], 0

        def put(space: int, first: int, many: int) -> int:
            """Fills up to `many` sequences that have `space` left; how many it has used."""
            nonlocal left, rank
            per, used = space // s, 0
            for count in (per, left % per):  # full ones, then one with what is left
                n = min(many - used, left // count) if count == per else min(many - used, 1) if 0 < left == count else 0
                if n:
                    runs.append((s, rank, n * count, count, first + used, window - space))
                    room[space - count * s].append((first + used, n))
                    rank, left, used = rank + n * count, left - n * count, used + n
            return used

        for space in range(s, window):
            while left and room[space]:
                first, many = room[space].pop()
                used = put(space, first, many)
                if used < many:
                    room[space].append((first + used, many - used))
            if not left:
                break
        if left:
            opened += put(window, opened, -(-left // (window // s)))
    return runs


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row per piece of `docs` (doc_id, text) with its sequence and its place there;
    `tokenizer` is the path of a byte-level tokenizer file."""
    cut = saved(pieces(docs, tokenizer, window, end))
    by_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(plan(histogram, window), RUNS)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    # the plan's size is bounded by the number of lengths
    slots = F.broadcast(runs.withColumnRenamed("length", "s"))
    index = F.col("rank") - F.col("first")
    return ranked.join(slots, (F.col("length") == F.col("s")) & (index >= 0) & (index < F.col("count"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div per")).alias("sequence_id"),
        (F.col("at") + index % F.col("per") * F.col("length")).alias("offset"),
    )
