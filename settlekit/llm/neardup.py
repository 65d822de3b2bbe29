"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

1. *Sets.* Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a document's set
   holds its distinct shingles of five words (a shorter text is one shingle) as 64-bit hashes.
   Documents with equal sets share a 128-bit digest and are one node from here on, so a group of
   copies, however large, is one node.
2. *Signatures.* One permutation: a shingle's hash picks a bin and a value, and a bin keeps its
   least value. An empty bin borrows the value of a full bin that is found by hashing
   (bin, attempt) until a full one is hit (optimal densification), the same way for every set.
3. *Candidates.* Bands of rows of the signature are hashed to buckets. In a bucket each node is
   paired with one centre only, a star, so pairs number at most nodes x bands. The centre is the
   bucket's node that shares buckets with the most others: of copies with edits of one text it is
   one with few edits, and near to whatever is near to any of them.
4. *Confirmation.* Each node's best star edge (most bands in common) is checked on the full sets
   of both texts; edges whose ends are not yet in one component are checked after that.
5. *Rest.* A star can miss two nodes that are similar to each other and not to the centre. The
   buckets that still span several components are searched in full: their members are dealt into
   blocks, and each pair of blocks is compared in one task, pairs of different components only, each
   in the first bucket that it shares: by signatures, then by the `SKETCH` smallest hashes of
   both sets (all of them, for most texts). Only pairs that are similar by these leave the task,
   to be confirmed as before.

With 128 bins in 32 bands of 4, two sets of similarity 0.75 miss every bucket with probability
5e-6, and less above. The threshold itself is exact: 100 * |A and B| >= 75 * |A or B|.

Edge cases: a text without words (or null) has an empty set, links with nothing and is kept; rows
that repeat an id and a text are copies of each other; rows that share an id but not a text are
linked only if their texts are; a null doc_id is never a component's id unless all its documents
have none, and is not kept beside others; an empty table gives an empty result; extra columns are ignored;
long texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import saved
from settlekit.llm.components import SALTS, components

SHINGLE, BINS, BANDS = 5, 128, 32
PERCENT = 75
#: Nodes (or rows of them) in a partition of what is saved on the way, at least.
PART_ROWS = 5_000
#: Nodes in a block of the exhaustive search of a bucket.
BLOCK = 256
#: Hashes of a set that the exhaustive search compares.
SKETCH = 1024
#: Standard deviations below similarity 0.75 at which an estimate rules a pair out there.
DEVIATIONS = 5.0
#: Texts of compared documents are found by a broadcast of their ids up to this many; beyond it
#: by a shuffled join. The result is the same.
BROADCAST_ROWS = 200_000

_MULTIPLIERS = np.array(
    [xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(SHINGLE)], dtype=np.uint64
)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    data = text.encode() if isinstance(text, str) else text or b""
    # bytes.lower and bytes.split know exactly A-Z, space and \x09-\x0D
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b"\n".join(words), seed=len(words))], dtype=np.uint64)
    hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total += hashes[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mix(total))


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For each bin the first bins that it borrows from, in order of attempts."""
    rng = np.random.default_rng(bins)
    return rng.integers(0, bins, size=(64, bins))


def signature(found: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The densified one-permutation signature of a set of hashes that is not empty."""
    mixed = _mix(found ^ np.uint64(0x9E3779B97F4A7C15))
    place = (mixed >> np.uint64(57)).astype(np.int64) % bins if bins == 128 else (mixed >> np.uint64(40)).astype(np.int64) % bins
    value = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint64)
    least = np.full(bins, np.uint64(1 << 40))
    np.minimum.at(least, place, value)
    empty = least == np.uint64(1 << 40)
    if empty.any():
        full, probes, attempt = ~empty, _probes(bins), 0
        open_bins = np.flatnonzero(empty)
        filled = least.copy()
        while len(open_bins):
            if attempt < len(probes):
                source = probes[attempt][open_bins]
            else:  # past the table: the same hash for every set
                source = (_mix(open_bins.astype(np.uint64) * np.uint64(2654435761) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
            hit = full[source]
            filled[open_bins[hit]] = least[source[hit]]
            open_bins = open_bins[~hit]
            attempt += 1
        least = filled
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> list[int]:
    rows = sig.reshape(bands, -1)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(rows)]


def least_agreement(n: np.ndarray) -> np.ndarray:
    """How many bins must agree for sets of at least n shingles to be compared; a set fills
    about BINS * (1 - exp(-n / BINS)) bins, and the agreement varies like a mean of so many."""
    filled = np.maximum(1.0, BINS * (1 - np.exp(-n / BINS)))
    share = PERCENT / 100
    return np.maximum(1.0, BINS * (share - DEVIATIONS * np.sqrt(share * (1 - share) / filled)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (md5 of the text), n_shingles, node (digest of the set, null if empty)
    and sig of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(x) for x in part.column(2).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "node", "sig"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key string, n_shingles long, node binary, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, band, node): a row for each node (node, sig) and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                node, sig = batch.column(0).slice(at, 2048), batch.column(1).slice(at, 2048).to_pylist()
                keys = [k for s in sig for k in band_keys(np.frombuffer(s, dtype=np.uint32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(node))),
                        node.take(pa.array(np.repeat(np.arange(len(node)), BANDS))),
                    ],
                    names=["key", "band", "node"],
                )

    return nodes.select("node", "sig").mapInArrow(run, "key long, band int, node binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough; `texts` is (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(batch.num_rows):
                if last[0] != b[i]:
                    last = (b[i], shingles(batch.column(3)[i].as_py()))
                x, y = shingles(batch.column(2)[i].as_py()), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in good], pa.binary()), pa.array([b[i] for i in good], pa.binary())], names=["a", "b"]
            )

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component of `found` (node, root)."""
    a = found.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = found.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def sketch(found: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hashes of a set, sorted; all of them if there are at most `SKETCH`."""
    mixed = _mix(found ^ np.uint64(0x9E3779B97F4A7C15))
    return np.unique((mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32))[:SKETCH]


def sketched_as_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets may be similar enough, by their sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    share, union = PERCENT / 100, len(a) + len(b) - both
    if len(a) < SKETCH and len(b) < SKETCH:
        return both >= (share - 0.01) * union  # equal 32-bit hashes of different shingles
    least = np.union1d(a, b)[:SKETCH]
    both = len(np.intersect1d(np.intersect1d(least, a, assume_unique=True), b, assume_unique=True))
    return both >= (share - DEVIATIONS * np.sqrt(share * (1 - share) / len(least))) * len(least)


def _similar_pairs(members: DataFrame) -> DataFrame:
    """Pairs of nodes of one bucket, of different components, that look similar; `members` is
    (key, band, blocks, block, node, root, n_shingles, sig, sketch)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("*", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "band", "block", "node", "root", "n_shingles", "sig", "sketch",
    )

    def run(table: pa.Table) -> pa.Table:
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        block = table["block"].to_numpy()
        node, sketches_ = table["node"].to_pylist(), table["sketch"].to_pylist()
        root = np.unique(np.array([x.hex() for x in table["root"].to_pylist()]), return_inverse=True)[1]
        a, b = [], []
        if root.max() > 0:
            least = least_agreement(table["n_shingles"].to_numpy())
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(len(block), -1)
            values = [np.frombuffer(x, dtype=np.uint32) for x in sketches_]
            for x in np.flatnonzero(block == i):
                y = np.flatnonzero((block == j) & (root != root[x]))
                y = y[y > x] if i == j else y
                if not len(y):
                    continue
                same = sig[y] == sig[x]
                # a bucket before this one has the pair already
                earlier = same.reshape(len(y), BANDS, -1)[:, :band].all(axis=2).any(axis=1)
                y = y[~earlier & (same.sum(axis=1) >= np.minimum(least[y], least[x]))]
                near = [k for k in y if sketched_as_similar(values[x], values[k])]
                a.extend([node[x]] * len(near))
                b.extend(node[k] for k in near)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def _sketched(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, sketch) of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [sketch(shingles(x)).tobytes() for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "sketch"])

    return texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "node binary, sketch binary")


def _unsettled(members: DataFrame, groups: DataFrame, texts: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The members of buckets that span several components, ready for `_similar_pairs`."""
    rooted = members.join(found, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    held = saved(rooted.join(open_keys.select("key"), "key", "left_semi"), parts)
    nodes = held.select("node").distinct()
    values = groups.select("node", "n_shingles", "sig").join(_sketched(nodes, texts), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return held.join(values, "node").select(
        "key", "band", blocks.alias("blocks"), F.pmod(F.xxhash64("node", "key"), blocks).cast("int").alias("block"),
        "node", "root", "n_shingles", "sig", "sketch",
    )


def _stars(members: DataFrame) -> DataFrame:
    """(a, b, shared): each node of a bucket with the bucket's centre, and how many buckets they
    share that way. A hot bucket is spread: its members are salted and its centre is repeated."""
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centres = members.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("centre"))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    spread = centres.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = salted.join(spread, ["key", "_salt"]).filter("node <> centre")
    return pairs.groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def links(docs: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """(node, root) for every node that is linked with another; what is saved has at most `parts`
    partitions. What is saved on the way is what several later steps read, for each saved table is a
    query of its own whose plan and code the driver keeps."""
    rows = bucket_rows(groups)
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(rows.join(buckets, "key").select("key", "band", "node", "n"), parts)
    stars = saved(_stars(members), parts)
    owners = members.select("node").distinct().join(groups, "node").select("node", "first_id", F.col("text_key").alias("_key"))
    owners = saved(owners, parts)
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("_key"))
    texts = saved(_keyed(docs).join(owners, same).select("node", "text"), parts)
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    linked = saved(confirmed(best, texts), parts)
    found = components(linked)
    # the other star edges: those that would still link two components
    more = saved(confirmed(_across(stars.join(best, ["a", "b"], "left_anti"), found), texts), parts)
    if not more.isEmpty():
        linked = linked.unionByName(more)
        found = components(linked)
    # pairs of different components are none of the linked ones
    rest = _similar_pairs(_unsettled(members, groups, texts, found, parts))
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    last = saved(confirmed(rest.join(seen, ["a", "b"], "left_anti"), texts), parts)
    return found if last.isEmpty() else components(linked.unionByName(last))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (md5 of the text) and node (the digest of
    the set) of every row of `docs`."""
    sets = saved(sketches(docs))
    full = sets.filter("node is not null")
    groups = saved(
        full.groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
        ).select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "n", "n_shingles", "sig")
    )
    parts = max(1, -(-groups.count() // PART_ROWS))
    found = links(docs, groups.coalesce(parts), parts)
    rooted = groups.join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    roots = found.join(groups, "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    # a component holds each text once and is spread over tasks
    salted = rooted.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    spread = roots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    labels = salted.join(spread, ["root", "_salt"], "left").select(
        "node", F.when(F.col("root") == F.col("node"), F.coalesce("least_id", "first_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    # both sides are written tables: a text with very many copies is split by the skew join
    placed = full.select("node", "doc_id", "text_key", "n_shingles").join(saved(labels, parts), "node")
    empty = sets.filter("node is null").select("node", "doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    result = placed.select("node", "doc_id", "text_key", "n_shingles", "component_id").unionByName(empty)
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "node")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one of each group stays; of rows that
    repeat an id and a text of that document, one."""
    found = saved(near_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept", "node"))
    gone = found.filter("not kept").select("_id", "_key").distinct()
    repeated = found.filter("kept and node is not null").groupBy("_id", "_key").count().filter("count > 1").select("_id", "_key")

    def bounded(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.md5(F.col("text").cast("string")).eqNullSafe(F.col("_key"))
    kept = docs.join(bounded(saved(gone)), same, "left_anti")
    repeated = saved(repeated)
    if repeated.isEmpty():
        return kept
    repeated = bounded(repeated)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
