"""Operators that are projections, windows and packing, against brute force and DuckDB."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from settlekit.llm import mixing, packing, sharding
from settlekit.llm.queries import word_tokenizer
from settlekit.llm.sql import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one two three", "en", "a", 13),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (4, "word " * 3000, "en", "b", 15000),
    (5, "x y z é ß 漢字", "de", "c", 5),
    (5, "x y z é ß 漢字", "de", "c", 5),
    (5, "another text of five", "de", "c", 5),
    (None, "no id here", "en", "d", 10),
    (7, "\t lead  and trail \n", "en", "b", 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    return df.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "target", "_hash", "words", "position")})


def test_slots_are_gapless_and_one_more_shard_only_takes(docs, spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 7).cast("int")).alias("text"))
    rows = sharding.placements(many).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        assert r.size == r.doc_id % 7 + 1 and r.text_crc32 == zlib.crc32(b"a" * (r.doc_id % 7))
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_slots_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = sharding.placements(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_edges(docs, empty):
    rows = sharding.placements(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(1, 0)}
    assert sharding.placements(empty).count() == 0


def test_weights_share_the_rows(spark):
    df = sharding.assign(spark.range(6000).withColumn("shard", F.lit("old")), "id", [1.0, 3.0])
    share = df.filter("shard = 1").count() / 6000
    assert abs(share - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def water_fill(sizes, weights, share, limit):
    """The targets, by raising the level until the sum is reached."""
    total, full, target = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(limit * sizes[i] for i in full)
        rest = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in rest)
        target = [limit * s if i in full else left * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i in rest if target[i] > limit * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    sizes = [100, 5000, 10, 700, 0, 900, 1]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert np.allclose(got, water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(7)], 1.5, 2.0))


def test_mixing_edges(docs, empty):
    rows = mixing.plan(clash(docs)).collect()
    assert len(rows) == len(ROWS)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
        assert sum(r.size for r in own) == own[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert all(sum(t.words for t in r.takes) == r.taken for r in own)
        assert all(0 <= t.position <= 1 for r in own for t in r.takes)
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_positions_invert_the_demand(spark):
    """At a take's position the integral of the source's schedule is the share taken before."""
    many = spark.range(400).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 11 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")
    )
    rows = mixing.plan(many).collect()
    for k, source in enumerate(("s0", "s1", "s2")):
        takes = sorted((t.position, t.words) for r in rows if r.source == source for t in r.takes)
        knots = mixing.SCHEDULES[k]
        ts, ws = np.array([t for t, _ in knots]), np.array([w for _, w in knots])
        grid = np.linspace(0, 1, 20001)
        density = np.interp(grid, ts, ws)
        area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(grid))])
        before, total = 0, sum(w for _, w in takes)
        for position, size in takes:
            assert abs(np.interp(position, grid, area) / area[-1] - before / total) < 1e-6
            before += size


def test_mixed_documents_are_cut_to_the_target(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    planned = {}
    for r in mixing.plan(docs).collect():
        planned[r.source] = planned.get(r.source, 0) + r.taken
    got = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in planned.items() if v}
    texts = {t for _, t, *_ in ROWS}
    assert all(r.text in texts or any(t and t.startswith(r.text) for t in texts) for r in rows)


def test_first_words(spark):
    text = " \n a  bb\tccc d "
    df = spark.createDataFrame([(text, i) for i in range(1, 5)], "t string, n int")
    got = [r[0] for r in df.orderBy("n").select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == [" \n a  ", " \n a  bb\t", " \n a  bb\tccc ", text]


def packed_rows(rows, tokenizer, texts):
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    return by, docs


def test_words_share_the_ids_of_their_parts():
    """A word's capital, marks and digits cost no further call of the tokenizer, and its ids stay those of the whole one."""
    words = packing.WordTokenizer(word_tokenizer())
    texts = [f"Item{i}, ITEM-{i}! (item) {i}% «Ítem»: ítem's\titem…\n" for i in range(500)]
    odd = ["", " \r\x0b x", "a\u0301 İ. ǅ ſ's ½ª", "X'LL don't 's ''s", "漢字, item 😀 12", "a<|endoftext|>b <|ENDOFTEXT|> c", "\u0301 \x85\xa0y"]
    want = [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts + odd]
    assert words.encode(texts) == want[:500]
    assert len(words.cache) < 40  # "item", ten digits and marks; not 2,000 words
    assert words.encode(odd) == want[500:]


def test_packing_against_the_tokenizer(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_tokenizer())
    odd = ["It's a TEST, don't!! they'll 3.14", "İstanbul ŉ ſ ΑΣ Σ ﬁ ² Ⅷ", "áb é nb sp", "<|endoftext|>x", "'s . ,;: a.b.c", "ÄÖÜ Straße."]
    texts = dict(enumerate([*odd, "", "word " * 9000, *["t " * n for n in range(1, 60)]]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(clash(df), word_tokenizer()).collect()
    by, found = packed_rows(rows, whole, texts)
    assert set(found) == set(texts)
    for doc_id, pieces in found.items():
        ids = [*whole.encode(texts[doc_id], add_special_tokens=False).ids, packing.END]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            data = np.array(ids[at : at + p.length], dtype="<u4").tobytes()
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(data), len(ids))
            at += p.length
        assert at == len(ids)
    # nothing is padded: sequences are full or have a power of two
    lengths = [sum(n for _, n in s) for s in by.values()]
    assert all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(empty, word_tokenizer()).count() == 0
    assert packing.pack(docs, word_tokenizer()).select("doc_id").distinct().count() == 7


def test_sum_of_squares_picks_the_least(monkeypatch):
    rng = np.random.default_rng(5)
    levels, window = packing.SumOfSquares(16), 16
    filled = {}
    for _ in range(2000):
        s = int(rng.integers(1, 16))

        def squares(h):
            count = np.bincount([v for v in filled.values() if 0 < v < window] or [0], minlength=window + 1)
            count[0] = 0
            if h:
                count[h] -= 1
            if h + s < window:
                count[h + s] += 1
            return (count**2).sum()

        choices = {0, *(v for v in filled.values() if 0 < v <= window - s)}
        least = min(squares(h) for h in choices)
        w, level = levels.place(s)
        assert filled.get(w, 0) == level and squares(level) == least
        filled[w] = level + s


def test_open_windows_are_bounded():
    packer = packing.Packer(64, 0, max_open=3)
    rng = np.random.default_rng(1)
    total, rows = 0, []
    for i in range(500):
        n = int(rng.integers(1, 63))
        total += n
        rows.extend(packer.add(i, b"\x01\x00\x00\x00" * n))
        assert len(packer.open) <= 3
    rows.extend(packer.finish())
    assert sum(r[2] for r in rows) == total


@pytest.mark.parametrize("name", ["op9_mixing", "op10_sharding"])
def test_against_duckdb(spark, tmp_path, name):
    from settlekit.llm.queries import QUERIES

    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(ROWS)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("most", [256, 8])
def test_few_tokens_leave_by_a_flush(most):
    """Uniform remainders of 20,000 documents in one task: what is laid end to end at the end is a
    small part, and no more windows than allowed are ever open."""
    random = np.random.default_rng(4)
    packer = packing.Packer(packing.WINDOW, 0, most)
    lengths = random.integers(1, packing.WINDOW, size=20_000)
    rows, widest = [], 0
    for i, n in enumerate(lengths.tolist()):
        rows += packer.add(i, b"\x01\0\0\0" * n)
        widest = max(widest, len(packer.open))
    at_end = list(packer.finish())
    assert widest <= most and sum(r[2] for r in at_end) < 0.05 * lengths.sum()
    by_doc, by_sequence = {}, {}
    for r in rows + at_end:
        by_doc.setdefault(r[0], []).append((r[1], r[2]))
        by_sequence.setdefault(r[5], []).append((r[6], r[2]))
    for i, n in enumerate(lengths.tolist()):
        assert sum(c for _, c in by_doc[i]) == n and sorted(by_doc[i])[0][0] == 0
    sizes = [sum(n for _, n in x) for x in by_sequence.values()]
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in sizes)
    assert all(sorted(x)[0][0] == 0 for x in by_sequence.values())


def test_new_words_are_tokenised_in_the_pass_that_asks_for_them():
    """No second pass over a text's words when one of them is new; the ids are the tokenizer's own."""
    import numpy as np
    import public_tokenizers

    from settlekit.llm import bestfit

    words = bestfit.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    cut, asked = words.cut, []
    words.cut = lambda text: (asked.append(x) or x for x in cut(text))  # can be read once
    text = "Zwolf quirlige Thlyouble, zwolf quirlige  Thlyouble\n42 über naïve – end"
    for _ in range(2):
        got = np.frombuffer(words.encode(text), dtype="<u4").tolist()
        assert got == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == 2 * len(cut(text))
