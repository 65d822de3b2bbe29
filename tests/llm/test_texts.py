"""Operators on texts against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from settlekit.llm import components, htmltext, langid, neardup, toxicity, warc
from settlekit.llm.queries import QUERIES
from settlekit.llm.sql import SQL

DOCS = "doc_id long, text string"
SF01 = "/root/testdata/sf0.01"


def rows_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- near-duplicates


def shingle_sets(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = [shingle_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(ids, default=None)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return out


def varied(seed, n=60):
    """Chains and stars of edited copies, short texts, copies, noise."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    rows, number = [], 0
    for _ in range(n // 10):
        text = [word() for _ in range(rng.choice([3, 5, 6, 9, 30, 80, 200]))]
        for _ in range(10):
            rows.append((number, " ".join(text)))
            number += rng.choice([1, 3])
            text = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    return rows


def answers(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = varied(seed, 150)
    assert answers(neardup.near_duplicates(rows_of(spark, rows))) == sorted(brute_components(rows), key=str)


def test_near_duplicate_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Only four words here"), (5, "only FOUR words here"), (6, "a b c d e f"), (6, "a b c d e f"),
            (6, "something else in all its words"), (None, "A b c d e f"), (None, None), (8, "x " * 30000)]
    df = rows_of(spark, rows).withColumns({c: F.lit(0) for c in ("node", "key", "n", "kept", "sig", "root")})
    got = answers(neardup.near_duplicates(df))
    assert got == sorted(brute_components(rows), key=str)
    left = neardup.deduplicated(df)
    assert left.columns == df.columns
    kept = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id)
    assert kept == sorted([(1, None), (2, ""), (3, " \t\n"), (4, rows[3][1]), (6, "a b c d e f"), (6, rows[7][1]), (8, rows[10][1])], key=lambda r: (r[0], r[1] or ""))
    empty = rows_of(spark, [])
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_missed_by_the_stars_is_found_in_the_buckets(spark):
    """Members of one bucket that are similar to each other and not to its centre."""
    rng = random.Random(3)
    base = [f"w{rng.random()}" for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 9):  # each is far from the first and near to its neighbours
        rows.append((i, " ".join([*base[i * 3 :], *(f"n{k}" for k in range(i * 3))])))
    assert answers(neardup.near_duplicates(rows_of(spark, rows))) == sorted(brute_components(rows), key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 8), (3, 4), (4, 4), (11, 10), (12, 11), (13, 12), (14, 13), (15, 14)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, **{i: 7 for i in (7, 8, 9)}, **{i: 10 for i in range(10, 16)}}


@pytest.mark.parametrize("rows", [100_000, 20])
def test_components_of_random_graphs(spark, monkeypatch, rows):
    """In one partition, and in many that share components; long paths, stars, loops, nulls, repeats."""
    monkeypatch.setattr(components, "PART_ROWS", rows)
    rng = random.Random(rows)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(80)] + [(5, 5), (7000, 7000), (None, 3), (4, None)] + edges[:20]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(12)
    got = [tuple(r) for r in components.components(df).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in parent)
    assert components.components(df.limit(0)).isEmpty()


def test_near_dedup_starts_few_jobs(spark):
    """Each saved table is a query whose plan and code the driver keeps."""
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "near-dedup")
    neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count()
    found = len(sc.statusTracker().getJobIdsForGroup("few jobs"))
    sc.setJobGroup("others", "others")
    assert 0 < found <= 70


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(0)
    agree = []
    for n in (4, 20, 400):
        both = rng.integers(0, 1 << 63, size=n * 6, dtype=np.uint64)
        a, b = np.unique(both[: n * 5]), np.unique(both[n:])
        agree.append((neardup.signature(a) == neardup.signature(b)).mean())
    assert all(abs(x - 4 / 6) < 0.2 for x in agree)


# --- language ID


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = QUERIES["op1_langid"](spark, SF01).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_edges_and_spans(spark):
    train = [(i, "the cat and the dog were in the house " * 20, "en") for i in range(10)]
    train += [(i, "der Hund und die Katze waren in dem Haus " * 20, "de") for i in range(10, 20)]
    train += [(i, "кошка и собака были в этом доме " * 20, "ru") for i in range(20, 30)]
    docs = rows_of(spark, train, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    ask = [(1, None), (2, "12 -- !"), (3, "²"), (4, "the dog and the cat " * 5 + "der Hund und die Katze " * 5 + "the house " * 12),
           (5, "собака"), (6, "das Haus" * 1), (7, "the cat " * 30000)]
    df = rows_of(spark, ask).withColumns({c: F.lit("x") for c in ("score", "lang_pred", "spans", "_text")})
    got = {r.doc_id: r for r in langid.identify(df, model, keep=["doc_id", "text", "score"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[2].spans == []
    assert got[4].lang_pred == "en" and [s.lang for s in got[4].spans] == ["en", "de", "en"]
    assert [(s.first_word, s.words) for s in got[4].spans] == [(0, 25), (25, 25), (50, 24)]
    assert got[5].lang_pred == "ru" and got[7].lang_pred == "en" and len(got[7].spans) == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.learn(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_language_is_that_of_most_letters(spark):
    """A foreign document between a short header and a footer, and short quotations inside."""
    train = [(i, "the cat and the dog were in the house " * 20, "en") for i in range(10)]
    train += [(i, "der Hund und die Katze waren in dem Haus " * 20, "de") for i in range(10, 20)]
    model = langid.learn(rows_of(spark, train, "doc_id long, text string, lang string"), F.lit(True))
    english, german = "the cat and the dog were in the house ", "der Hund und die Katze waren in dem Haus "
    ask = [(n, english * n + german * (20 - 2 * n) + english * n) for n in range(1, 10)]
    got = {r.doc_id: r for r in langid.identify(rows_of(spark, ask), model).collect()}
    letters = lambda t: sum(map(len, langid.words(t)))
    for n, text in ask:
        share = 2 * n * letters(english) / letters(text)
        assert got[n].lang_pred == ("en" if share > 0.5 else "de"), n
        assert [s.lang for s in got[n].spans] == ["en", "de", "en"] and got[n].score <= max(share, 1 - share) + 1e-9


def test_copies_of_a_text_count_once_in_the_model(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [" ".join(word() for _ in range(20)) for _ in range(300)]
    copied = {"many": "zzz " * 50, "more": "yyy " * 50}
    rows = [(0, t, "xx") for t in texts] + [(0, t, "xx") for t in copied.values() for _ in range(400)]
    once = [(0, t, "xx") for t in {*texts, *copied.values()}]
    schema = "doc_id long, text string, lang string"
    for most in (50, 100, 1000):
        models = [langid.learn(rows_of(spark, r, schema).repartition(5), F.lit(True), sample_docs=most) for r in (rows, once)]
        assert models[0].key == models[1].key
    assert models[0].languages == ["xx"]


@pytest.mark.parametrize(
    "text, found",
    [("CO₂ und x² é", ["co", "und", "x", "é"]), ("①甲方应当②乙方", ["甲方应当", "乙方"]), ("a²b", ["a", "b"]), ("Ⅷ ² ① 7", []), ("H₂O", ["h", "o"]), ("plain x_1", ["plain", "x"]), (None, [])],
)
def test_characters_that_are_no_letters_part_words(text, found):
    assert langid.words(text) == found and bool(found) == langid.has_letter(text or "")


def test_und_follows_has_letter(spark):
    train = [(i, "the cat and the dog were in the house " * 20, "en") for i in range(10)]
    train += [(i, "甲方应当在合同签订后支付货款" * 20, "zh") for i in range(10, 20)]
    model = langid.learn(rows_of(spark, train, "doc_id long, text string, lang string"), F.lit(True))
    ask = [(1, "①甲方应当②在合同签订"), (2, "x² cat³"), (3, "² ① Ⅷ"), (4, "CO₂")]
    got = {r.doc_id: r for r in langid.identify(rows_of(spark, ask), model).collect()}
    assert got[1].lang_pred == "zh" and got[2].lang_pred == "en" and got[4].lang_pred != "und" and got[4].score > 0
    assert all((got[i].lang_pred == "und") != langid.has_letter(t) for i, t in ask)


def brute_path(scores, switch):
    """The best path over one text by trying all."""
    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])),
    )
    return sum(scores[i, s] for i, s in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 0, 1, 7, 3])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    path = langid.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        s, p = scores[at : at + n], path[at : at + n]
        at += n
        if n:
            value = sum(s[i, k] for i, k in enumerate(p)) - 2.0 * (np.diff(p) != 0).sum()
            assert math.isclose(value, brute_path(s, 2.0), rel_tol=1e-4, abs_tol=1e-4)


# --- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = ["scum", "idiot", "idiom", "moron", "disgusting", "worthless"]
    lexicon = toxicity.Lexicon(terms)
    tried = list(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < 0.4:
                w.insert(k, rng.choice("aeidmotsx"))
            elif w and kind < 0.7:
                del w[min(k, len(w) - 1)]
            elif w:
                w[min(k, len(w) - 1)] = rng.choice("aeidmotsx")
        tried.append("".join(w))
    for w in tried:
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t))
        got = lexicon.match(w)
        assert got == ((near[0][1], near[0][0]) if near else None), w


def abuse_model():
    return toxicity.Model(-2.0, {"idiot": 6.0, "worthless": 6.0, "moron": 6.0}, {"idiot": 4.0, "worthless": 4.0, "moron": 0.0}, {"idiom": 0.0})


def test_context_parts_quotation_from_abuse(spark):
    model = abuse_model()
    score = lambda t: toxicity.Scorer(model).score(t)[0]
    assert score("you are an idiot and that is it") > 0.5
    assert score("what an idiiot he is") > 0.5 and score("so worthles") > 0.5
    assert score("the idiom is fine, and so is maron") < 0.5
    assert score('he was told "this idiot should leave" by the man') < 0.5
    assert score("er nannte ihn „idiot“ und ging") < 0.5
    assert score("the word idiot comes from greek") < 0.5
    assert score('"a" moron is what you are') > 0.5
    rows = [(1, None), (2, ""), (3, "fine " * 30000), (4, "fine " * 30000 + "idiot"), (5, "IDIOT"), (5, "IDIOT")]
    df = rows_of(spark, rows).withColumns({c: F.lit("x") for c in ("score", "hits", "_text")})
    got = sorted((r.doc_id, r.predicted) for r in toxicity.assess(df, model, keep=["doc_id", "score"]).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1)]
    assert toxicity.assess(df.limit(0), model).count() == 0


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, SF01).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    empty = toxicity.learn(rows_of(spark, []), labels.limit(0), F.lit(True))
    assert not empty.weights


def labelled_texts(rare, seed=5):
    """400 toxic texts of one word, those of `rare`, and 2,000 clean ones, in invented words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(3, 9)))
    common = [word() for _ in range(300)]
    text = lambda *bad: " ".join(rng.sample([*rng.choices(common, k=30), *bad], 30 + len(bad)))
    texts = [(text("scumbag"), 1) for _ in range(400)] + [(text(w), 1) for w in rare] + [(text(), 0) for _ in range(2000)]
    return [(i, t, y) for i, (t, y) in enumerate(texts)]


@pytest.mark.parametrize("rare", [["dummkopf"] * 14, [f"blöd{x}" for x in ("mann", "sack", "er", "heit", "kopf", "maul", "es")] * 2], ids=["word", "stem"])
def test_sparse_terms_are_learned_from_all_labels(spark, monkeypatch, rare):
    """However few of a group of terms are in the sample, which only sets the threshold."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 200)
    rows = labelled_texts(rare)
    df = rows_of(spark, rows, "doc_id long, text string, toxic int")
    got = {}
    for limit in (toxicity.BROADCAST_LABELS, 10):  # found by a broadcast, and by a shuffle
        monkeypatch.setattr(toxicity, "BROADCAST_LABELS", limit)
        monkeypatch.setattr(toxicity, "COUNT_KEYS", 500)
        model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
        found = {r.doc_id: r.predicted for r in toxicity.assess(df, model).collect()}
        assert all(found[i] == 1 for i, _, y in rows if y) and sum(found[i] for i, _, y in rows if not y) <= 2
        got[limit] = model.key
    assert len(set(got.values())) == 1
    score = toxicity.Scorer(model).score
    assert score(f"sum ergo {rare[0]} anno")[0] > 0.5 and score("sum ergo anno")[0] < 0.5
    if rare[0] != rare[1]:  # a form that was never seen
        assert score("sum ergo blödian anno")[0] > 0.5


def test_toxic_texts_of_every_language_are_found(spark):
    path = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    rows = rows.join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.filter("held_out and toxic is not null").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic == 1]
        assert sum(toxic) >= 0.8 * len(toxic) > 0, lang
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.02 * len(clean)


# --- HTML


PAGE = '<html><head><title>t</title></head><body><nav><a href="/">Menu {i}</a></nav><article><h1>Title {i}</h1><p>Text {i} &amp; more\n of  it.</p><p class="{c}">{s}</p><p>End<br>of {i}</p></article><footer>Foot {i}</footer></body></html>'


def test_low_importance_branches_go(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, c="boiler", s="Read our terms.")) for i in range(12)]
    rows += [(20 + i, f"http://b.example/{i}", PAGE.format(i=i, c="boiler", s=f"Unique words {i * i}.")) for i in range(12)]
    rows += [(40, "http://c.example/1", PAGE.format(i=1, c="boiler", s="Read our terms."))]
    # copies of one article do not make it a template
    rows += [(50 + i, f"http://d.example/{i}", PAGE.format(i=1, c="x", s="Same.")) for i in range(12)]
    got = {r.page_id: r for r in htmltext.extract(rows_of(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title 3\nText 3 & more of it.\nEnd of 3"
    assert got[23].text == "Title 3\nText 3 & more of it.\nUnique words 9.\nEnd of 3"
    assert "Read our terms." in got[40].text and got[55].text == "Title 1\nText 1 & more of it.\nSame.\nEnd of 1"
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("constant, unique", [("<div>Fixed {k}</div>", "<p>{t}</p>"), ("<p>Fixed {k}</p>", "<p>{t}</p>"), ("<div>Fixed {k}</div>", "<div><div><p>{t}</p></div></div>")])
@pytest.mark.parametrize("blocks, own", [(12, 1), (20, 3)])
def test_constant_blocks_do_not_outvote_the_article(spark, constant, unique, blocks, own):
    article = lambda i: [f"Story {i} part {k} tells of {i * 7 + k} things." for k in range(own)]
    fixed = "".join(constant.format(k=k) for k in range(blocks))
    rows = [(i, f"http://a.example/{i}", f"<html><body><div>{fixed}{''.join(unique.format(t=t) for t in article(i))}</div></body></html>") for i in range(100)]
    got = htmltext.extract(rows_of(spark, rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n".join(article(i)) for i in range(100)}


def test_importance_against_the_formulas(spark):
    """Content: 1 minus the mean entropy of the texts; presentation: entropy of the sequences."""
    rows = []
    for page in range(8):
        rows += [("h", page, 1, False, 100 + (page % 2), True), ("h", page, 2, True, 7, False), ("h", page, 2, False, 100 + (page % 2), False)]
    df = spark.createDataFrame(rows, "host string, page long, path long, style boolean, digest long, leaf boolean")
    got = {r.path: r.importance for r in htmltext.importance(df).collect()}
    entropy = math.log(4) / math.log(8)
    assert math.isclose(got[1], 1 - entropy) and math.isclose(got[2], 0.9 * (1 - entropy) + 0.1 * 0)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("just  text &lt;b&gt; x", "just text <b> x"),
        ("<body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a<b>b</b> c<p>d<ul><li>e<li>f</ul>g</article><footer>z", "T & U\nab c\nd\ne\nf\ng"),
        ('<body><script>if (a<b) "</p>"</script><p>hello<script>never closed <p>x', "hello"),
        ('<body><div class="header">top</div><div><p>one</p><div class="comments"><p>no</p></div></div>', "one"),
        ('<p title="a>b">x</p><!-- <p>no</p> --><p>yes<!-- x', "x\nyes"),
        ('<article><header><h1>H</h1></header><p>p</p><aside>a</aside><form>f</form><section id="comments"><p>c</p></section></article>', "H\np"),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<p style='display: none'>no</p><p hidden>no</p><p>yes", "yes"),
        ("<article><p>x" + " y" * 50000 + "</article>", "x" + " y" * 50000),
    ],
)
def test_pages(html, text):
    assert "\n".join(b.text for b in htmltext.parse(html or "")[0]) == text


ARTICLE = '<main><article><h1>T</h1><p>the story</p></article></main><div class="sidebar"><p>side</p></div>'


@pytest.mark.parametrize("names", ['class="content-sidebar-wrap"', 'class="site no-sidebar"', 'id="page" class="has-header"', 'class="page with-comments"'])
@pytest.mark.parametrize(
    "inner, text",
    [
        (ARTICLE, "T\nthe story"), (ARTICLE.replace("<main>", "").replace("</main>", ""), "T\nthe story"),
        ('<div class="body"><h1>T</h1><p>the story is long</p></div><div class="comments"><p>no</p></div>', "T\nthe story is long"),
        ('<div class="body"><h1>T</h1><p>the story</p></div><div class="comments"><p>many more words than the story has</p></div>', "T\nthe story"),
    ],
)
def test_wrappers_with_words_of_noise(names, inner, text):
    page = f"<html><body><nav>Menu</nav><div {names}>{inner}</div><footer>z</footer></body></html>"
    assert "\n".join(b.text for b in htmltext.parse(page)[0]) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div><p>the story</p></div><div class="related-posts"><article>one</article><article>two</article></div>', "the story"),
        ('<article>the story</article><div class="related-posts"><article>another story that is longer</article></div>', "the story"),
        ('<p>the story</p><div class="widget-post"><article>first text</article></div><div class="widget-post"><article>next text</article></div>', "first text\nnext text"),
        ('<p>the <a class="share">x</a> story <span class="ad"><b>y</b></span>ends</p>', "the story ends"),
        ('<div class="notice"><p>the story</p></div>', "the story"),
    ],
)
def test_named_noise_beside_the_article(html, text):
    assert "\n".join(b.text for b in htmltext.parse(html)[0]) == text


@pytest.mark.parametrize("svg", ["<svg/>", '<svg class="icon" />', "<svg viewBox='0 0 1 1' d=\"a/>b\"/>", "<SVG />"])
def test_a_self_closed_svg_ends_at_its_own_tag(svg):
    read = lambda html: "\n".join(b.text for b in htmltext.parse(html)[0])
    assert read(f"<p>a</p>{svg}<p>b</p>") == "a\nb"
    assert read(f"<p>a {svg} b</p><svg><text>no</text></svg><p>c</p>") == "a b\nc"
    assert read('<p>a</p><svg class="x/"><path d="M0"/><text>no</text></svg><p>b</p>') == "a\nb"


@pytest.mark.parametrize("tag", ["iframe", "noscript", "title"])
def test_an_unclosed_raw_element_leaves_the_rest(tag):
    read = lambda html: "\n".join(b.text for b in htmltext.parse(html)[0])
    assert read(f"<p>a</p><{tag} x='1'><p>b</p><{tag}>no</{tag}><p>c</p>").endswith("c")
    assert read(f"<p>a</p><{tag} x='1'><p>b</p><p>c</p>") == "a\nb\nc"


def test_html_edges(spark):
    rows = [(1, None, None), (2, None, "<p>a"), (2, "no host", "<p>a"), (None, "http://h/", "")]
    df = rows_of(spark, rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "paths", "text", "_host")})
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, None, "a", 1), (2, "no host", "a", 1), (None, "http://h/", "", 0)], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


# --- WARC


def pages(n=400):
    rng = random.Random(6)
    html = ["<html>" + " ".join(rng.choices(["alpha", "beta", "gamma", "é"], k=rng.randrange(400))) for _ in range(n // 2)]
    return [(i, f"http://h{i % 7}/a b\n{i}", html[rng.randrange(len(html))]) for i in range(n)] + [(n, None, None), (n + 1, None, ""), (None, "u", html[0])]


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    df = rows_of(spark, rows, "page_id long, url string, html string").repartition(3).withColumns({c: F.lit(1) for c in ("sha1", "first", "n", "_page")})
    manifest = warc.write(df, str(tmp_path / "w"))
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r.page_id: r for r in warc.read(manifest, str(tmp_path / "w")).collect()}
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        same = first[h or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if same else ("revisit", first[h or ""]))
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_an_archive_is_readable_record_by_record(tmp_path):
    import struct

    import zstandard

    system, _ = warc._open(str(tmp_path))
    archive = warc.Archive(system, f"{tmp_path}/a.warc.zst")
    data = [warc.record(i, f"http://x/{i}", f"<p>page {i} some words in common</p>".encode() * 40, None, False) for i in range(4000)]
    for x in data:
        archive.add(x)
    path, records, written = archive.close()
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size > 0 and written == len(raw) < sum(map(len, data)) / 5
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert one == data[0]
    assert list(warc.read_archive(system, path)) == data
    with pytest.raises(ValueError):
        warc.parse(data[0].replace(b"some", b"sane"))


@pytest.mark.parametrize("name, view", [("op4_warc", "pages"), ("op5_neardup", "documents")])
def test_against_duckdb(spark, tmp_path, name, view):
    if view == "pages":
        df = rows_of(spark, [r for r in pages(120) if r[0] is not None], "page_id long, url string, html string")
    else:
        df = rows_of(spark, varied(5), DOCS)
    df.write.parquet(f"{tmp_path}/{view}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view {view} as select * from read_parquet('{tmp_path}/{view}.parquet/*.parquet')")
    want = con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_held_out_rows_follow_the_checksum(spark):
    rows = QUERIES["op1_langid"](spark, SF01).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_the_threshold_errs_least():
    found = [(-2.0, False)] * 20 + [(3.0, False)] * 2 + [(3.0, True)] + [(7.0, True)] * 5 + [(6.5, True)]
    assert toxicity.threshold(found, 1.0, 1.0) == (3.0 + 6.5) / 2
    assert 0 < toxicity.threshold(found, 10.0, 1.0) < 3.0
    assert toxicity.threshold([(-2.0, False), (5.0, True)], 1.0, 1.0) == 2.5


STORY = "<p>" + "A long story about the river and the boats that come home. " * 20 + "</p>"


@pytest.mark.parametrize("html, want", [
    (f'<div id="content"><h1>Title</h1>{STORY}</div><section class="latest"><article><h3>Other teaser</h3></article></section>', "Title"),
    ('<div class="story"><p>text one, which is longer</p></div><article class="card">teaser</article>', "text one"),
    (f"<div>short note</div><article>{STORY}</article>", "A long story"),
    (f"<p>{'x ' * 3000}</p><main><p>the main text</p></main>", "the main text"),
])
def test_articles_that_are_teasers_do_not_win(html, want):
    blocks, _ = htmltext.parse(html)
    assert blocks[0].text.startswith(want)
    assert not any("teaser" in b.text for b in blocks if b.main) or "teaser" not in want


@pytest.mark.parametrize("name", ["share-buttons", "post-tags", "reader-responses", "comment-list"])
def test_noise_inside_an_article(name):
    blocks, _ = htmltext.parse(f'<div class="content-sidebar-wrap"><article><p>A text of its own</p><div class="{name}"><p>Share</p></div></article></div>')
    assert [b.text for b in blocks] == ["A text of its own"]


@pytest.mark.parametrize("legal", ["All rights reserved by the owner of this site. ", "All rights reserved. " * 60])
def test_a_long_block_on_every_page_is_cleaned(spark, legal):
    page = "<div><div>Home News Sport Weather</div></div><div><p>{0}first words of its own</p><p>and {0}others</p></div><div><div>{1}</div></div>"
    rows = [(i, f"https://x.example/{i}", page.format(f"page{i} " * 5, legal)) for i in range(60)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{f'page{i} ' * 5}first words of its own\nand {f'page{i} ' * 5}others" for i in range(60)}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_a_page_carries_only_its_own_keys(spark, monkeypatch, limit):
    """A host with many removed elements, and one that has none, by both ways."""
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", limit)
    notes = [f"<div><div><div>legal note {j} of this site</div></div></div>" for j in range(40)]
    # each note is on most pages, beside one that is the page's own
    page = lambda i: "<div>" + "".join(n for j, n in enumerate(notes) if (i + j) % 10) + f"<div><div><div>note {i}</div></div></div><p>{f'own words {i} ' * 30}</p><p>more of page {i}</p></div>"
    rows = [(i, f"https://Hot.example/{i}", page(i)) for i in range(80)]
    rows += [(100 + i, f"https://other.example/{i}", f"<p>one {i}</p><p>two {i}</p>") for i in range(9)] + [(200, None, None), (7, rows[7][1], rows[7][2])]
    df = rows_of(spark, rows, "page_id long, url string, html string")
    removed = htmltext.noise(df)
    assert removed.count() >= 40 and {r.host for r in removed.collect()} == {"hot.example"}
    carried = htmltext.drops(df.select(F.lit("hot.example").alias("host"), F.col("page_id").cast("string").alias("page"), F.coalesce("html", F.lit("")).alias("html")), removed)
    assert 36 <= carried.agg(F.max(F.size("keys"))).first()[0] < removed.count()
    got = sorted((r.page_id, r.text) for r in htmltext.extract(df).collect())
    own = lambda i: f"note {i}\n{f'own words {i} ' * 30}".strip() + f"\nmore of page {i}"
    assert got == sorted([(i, own(i)) for i in range(80)] + [(7, own(7)), (200, "")] + [(100 + i, f"one {i}\ntwo {i}") for i in range(9)])
