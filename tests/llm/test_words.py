"""Phrases, best-fit packing and spelling variants, against brute force, DuckDB and the tokenizer."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from settlekit.llm import bestfit, common, phrases, variants
from settlekit.llm.queries import QUERIES, byte_tokenizer
from settlekit.llm.sql import SQL

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def group_rows(file):
    """Rows of each row group of a Parquet file."""
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    return [found.row_group(i).num_rows for i in range(found.num_row_groups)]


# --- phrases ---------------------------------------------------------------------------------


def all_phrases(rows, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][" ".join(words[i : i + k])] += 1
    return counts, totals


def brute_collocations(rows, least, top):
    counts, totals = all_phrases(rows)
    found = []
    for lang, f in counts.items():
        c = {p: n for p, n in f.items() if n >= least and " " in p}
        dropped = set()
        for p, n in c.items():
            w = p.split(" ")
            inside = {" ".join(w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)}
            dropped |= {s for s in inside if 100 * n >= 80 * c[s]}
        ranked = []
        for p in c.keys() - dropped:
            w, a = p.split(" "), c[p]
            cuts = [(k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, x, y in cuts)
            ranked.append((-score, -a, p.encode(), (p, a, left, right, totals[lang], score)))
        found += [(lang, i, *row[3]) for i, row in enumerate(sorted(ranked)[:top], 1)]
    return sorted(found)


@pytest.mark.parametrize("block", [200_000, 50])
def test_collocations_equal_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)  # many tries give the same counts
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in phrases.collocations(documents, top=60, least=8).collect())
    assert got == brute_collocations(rows, 8, 60) and len(got) > 60


def test_collocations_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op11_phrases"](spark, SF01).collect())
    assert got == sorted(con.sql(SQL["op11_phrases"]).fetchall()) and len(got) > 100


def test_collocations_of_odd_rows(spark, empty):
    assert phrases.collocations(empty).collect() == []
    texts = ["a b a b. A  B\tc", "x;x x x", "", None, "no phrase", "ÄB äb a\x0bb", "a b" * 40, "w " * 90_000]
    rows = [(i, t, lang, None, 0) for i, t in enumerate(texts) for lang in ("de", None, "und") for _ in range(3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("words", "codes", "n", "phrase", "size", "hash")})
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect())
    assert got == brute_collocations([(r[2], r[1]) for r in rows], 3, 2000)
    assert phrases.collocations(docs.filter("doc_id in (2, 3)")).collect() == []


def test_filter_may_be_full():
    """Hashes that share a bit cost candidates, not counts: a full filter lets all phrases through."""
    text = "a b c a b c d. a b c; x y"
    words, codes = phrases.words_of([text.encode()] * 3)
    own = phrases._word_hashes("en", words.to_pylist())
    full = np.full(1 << 10, 255, np.uint8)
    for size in (2, 3, 4):
        heads, last, times = phrases.open_phrases(own, codes, [full] * (size - 1))
        counts, _ = all_phrases([("en", text)] * 3, size)
        assert sorted(times.tolist()) == sorted(n for p, n in counts["en"].items() if p.count(" ") == size - 1)
    none = np.zeros(1 << 10, np.uint8)
    assert len(phrases.open_phrases(own, codes, [full, none, full])[0]) == 0


def test_a_small_filter_gives_the_same(documents, monkeypatch):
    want = sorted(tuple(r) for r in phrases.collocations(documents, top=60, least=8).collect())
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    assert sorted(tuple(r) for r in phrases.collocations(documents, top=60, least=8).collect()) == want


def test_trie_finds_all_and_nothing_else():
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}".encode() for i in range(300)]
    texts = [[vocabulary[int(x)] for x in np.minimum(random.zipf(1.4, 400) - 1, 299)] for _ in range(20)]
    made = {(lang, *t[i : i + k]) for lang, t in zip(["en", "de"] * 10, texts) for k in (1, 2, 3, 4) for i in range(0, 390, 7)}
    made = sorted(made, key=str)
    trie = phrases.Trie.build([m[0] for m in made], [list(m[1:]) for m in made])
    assert sorted(trie.accepts[trie.accepts >= 0].tolist()) == list(range(len(made)))
    sums = np.zeros(len(trie.check), dtype=np.int64)
    want = Counter()
    for lang, text in zip(["en", "de", "fr", "en"] * 5, texts):
        words = sorted(set(text))
        codes = np.array([words.index(w) + 1 for w in text] + [0], dtype=np.int32)
        trie.count(lang, words, codes, sums)
        want.update((lang, *text[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(text) - k + 1))
    for state in np.flatnonzero(trie.accepts >= 0):
        assert sums[state] == want[made[trie.accepts[state]]]


def test_score_passes_64_bits(spark):
    huge = 6_000_000_000_000_000_000
    rows = [("en", "a b", 2, huge), ("en", "a", 1, huge + 1), ("en", "b", 1, huge + 5)]
    row = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long")).first()
    assert row.score == 2_000_000 * huge // (2 * huge + 6)


def test_shards_are_held_a_few_at_a_time(spark, monkeypatch):
    """By the writer and readers of their table, and in the batches for Python workers: shards are megabytes."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(phrases, "GROUP_BYTES", 1 << 16, raising=False)
    random = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 1 << 40, size=1200)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)], DOCS).coalesce(1)
    written = phrases._written(phrases.encode(docs))
    rows = [x for f in written.inputFiles() for x in group_rows(f)]
    assert sum(rows) == 150 and max(rows) <= 10

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16)
    with common.small_batches(spark):
        assert max(r.n for r in written.mapInArrow(sizes, "n long").collect()) <= 10
    limits, counted = [], phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *a: [limits.append(spark.conf.get(key)), counted(*a)][1])
    phrases.collocations(docs, least=2).collect()
    assert limits == [str(1 << 16)] and spark.conf.get(key) == before


# --- best fit --------------------------------------------------------------------------------


def check_packing(rows, texts, window=2048, end=0):
    """All pieces lie where the contract says; the number of sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // window)
        at = 0
        for r in pieces:
            assert r.start == at and (r.length == window or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def per_item(lengths, window):
    """Best fit decreasing, one item at a time."""
    rooms = []
    for s in sorted(lengths, reverse=True):
        fits = [x for x in rooms if x >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(window - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plan_equals_best_fit_by_item(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, [101, 40, 101, 60][seed], size=[400, 900, 60, 700][seed])
    if seed == 3:
        lengths[:300] = 7  # a hot length
    runs = bestfit.plan(Counter(lengths.tolist()), 100)
    room = defaultdict(lambda: 100)
    for s, _, n, per, first, at in sorted(runs, key=lambda r: r[5]):
        for i in range(n):
            assert 100 - room[first + i // per] == at + i % per * s
            room[first + i // per] -= s
    assert sorted(room.values()) == per_item(lengths.tolist(), 100)
    for s, n in Counter(lengths.tolist()).items():
        own = sorted((r[1], r[2]) for r in runs if r[0] == s)
        assert own[0][0] == 0 and sum(c for _, c in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))


def test_plan_has_few_runs_however_many_documents():
    random = np.random.default_rng(1)
    lengths = random.integers(1, 2049, size=100_000)
    few = len(bestfit.plan(Counter(lengths.tolist())))
    many = len(bestfit.plan({s: n * 10_001 for s, n in Counter(lengths.tolist()).items()}))
    assert few < 10_000 and many < 10_000
    assert bestfit.plan({}) == []


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = QUERIES["op12_bestfit"](spark, SF001).collect()
    sequences = check_packing(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert sequences <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_odd_rows(spark, empty):
    assert bestfit.pack(empty, byte_tokenizer()).collect() == []
    texts = ["", None, "one", " two  three\n\n\tx ", "<|endoftext|> b", "漢字 Ω", "it's I'LL ²³ 12½ …", "\x1cu v\x85w", "a " * 2047, "a " * 2048, "word " * 50_000]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    clash = docs.withColumns({c: F.lit("x") for c in ("piece", "length", "part", "rank", "first", "count", "s", "per")})
    check_packing(bestfit.pack(clash.repartition(3), byte_tokenizer()).collect(), dict(enumerate(texts)))
    same = spark.createDataFrame([(None, "same text", None, None, 0)] * 700, DOCS).repartition(5)
    rows = bestfit.pack(same, byte_tokenizer()).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 700
    assert {r.sequence_id for r in rows} == set(range(-(-700 // (2048 // rows[0].length))))


# --- variants --------------------------------------------------------------------------------


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    masks, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    found = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(found)


@pytest.mark.parametrize("block", [768, 4])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)  # blocks of many parts give the same pairs
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    if block == 4:
        docs = docs.filter("n_chars < 2000")
    got = sorted(tuple(r) for r in variants.variants(docs).collect())
    assert got == brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[1] is not None for r in got) > 20 or block == 4


def test_variants_of_odd_rows(spark, empty):
    assert variants.variants(empty).collect() == []
    chain = ["abcdef"] * 5 + ["abcdeg"] * 30 + ["abcdegh"] * 200 + ["bacdef"] * 6 + ["abcdfe"] * 7 + ["Äbcdef"] * 9 + ["÷äbcde"] * 5
    texts = [" ".join(chain), None, "", "x" * 200_000 + " é", "漢字abcdeg1ABCDEG", "\xc3\xa9" * 9 + "-" + "straße " * 40]
    rows = [(i if i else None, t, None, None, 0) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "form", "length", "part")})
    got = sorted(tuple(r) for r in variants.variants(docs).collect())
    assert got == brute_variants([(r[0], r[1]) for r in rows])
    root = {r[0]: r[2] for r in got}
    assert root["abcdef"] == "abcdegh"  # two steps


def test_crc_of_pairs():
    random = np.random.default_rng(5)
    heads = [f"{random.integers(1 << 40)}:".encode() for _ in range(50)]
    words = [random.bytes(int(n)) for n in random.integers(0, 65, size=50)]
    got = variants.pair_crcs(
        np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([len(w) for w in words]), np.array([zlib.crc32(w) for w in words], np.uint32)
    )
    assert got.tolist() == [zlib.crc32(h + w) for h, w in zip(heads, words)]


def test_near_pairs_equal_all_pairs():
    random = np.random.default_rng(9)
    make = lambda n, k: sorted({bytes(random.choice(list(b"ab\xe9"), size=k).tolist()) for _ in range(n)})
    short, longer = make(60, 6), make(60, 7)
    i, j = variants.near_pairs(short, short, True)
    want = {(a, b) for a in range(len(short)) for b in range(a + 1, len(short)) if sum(x != y for x, y in zip(short[a], short[b])) == 1}
    assert set(zip(i.tolist(), j.tolist())) == want and want
    i, j = variants.near_pairs(short, longer, False)
    want = {(a, b) for a, s in enumerate(short) for b, t in enumerate(longer) if any(t[:k] + t[k + 1 :] == s for k in range(7))}
    assert set(zip(i.tolist(), j.tolist())) == want and want
