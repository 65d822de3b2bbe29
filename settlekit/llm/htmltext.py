"""Main text of HTML pages by site style trees.

The DOMs of a host's pages are merged into one style tree: an element is known by its path of
tags and classes from the root, and the tree counts, for each element, over how many distinct
pages each sequence of child tags (its presentation) and each text (its content) occurs. From
these counts an element gets an importance between 0 and 1:

* presentation: the entropy of its child sequences, to base m (m distinct pages of the host). A
  branch that looks the same everywhere has 0.
* content: 1 minus the mean entropy, to base m, of its texts over the pages. A text on every page
  has entropy 1, a text on one page 0; the mean is weighted by occurrences.
* both: (1 - g^c) * presentation + g^c * content, with c child sequences and g = `DAMPING`.
  Elements that hold text themselves count by content alone.

A branch is removed only if it and all below it is of importance below `LEAST_IMPORTANCE`, so the
element that holds a text decides about it, however much constant text is around; where such an
element also holds texts that are not low by themselves (1 minus their own entropy), those stay.
Nothing is removed from a host of fewer than `LEAST_PAGES` distinct pages (they tell nothing). Pages count as distinct by their longest
block, so copies of an article under many addresses do not make the article look like a
template. An element's importance is the mean over all texts at its path; one passage that many
articles share does not remove the path that holds it.

Entropy alone can't tell a menu or a footer whose texts differ on every page from an article, so
elements whose tag, role or class names a menu, header, footer, sidebar, notice, advert, form,
script, style or reader comments are removed as well, and where a page has article (or main)
elements only those are read. A word of a class or id is a weaker sign than a tag or role, as
layout wrappers have such words too (`has-sidebar`): it does not count for an element that holds
`main`, an article or most of the page's text (see `_named` for what names are stronger).

The tree is counted with DataFrame aggregations: rows of (host, element, text digest, page
digest), combined on the map side; a host with a third of all pages is spread over all tasks. The
elements and texts to remove are a table of (host, key); it is saved, and if it has at most
`BROADCAST_ROWS` rows broadcast once to each worker, so that no page carries its host's keys: pages are
parsed twice and not shuffled. Beyond, the keys that a page itself holds are joined with the table by
host and key, and come back to the page by a digest of its html; AQE splits keys that very many
pages hold. The result is the same.

Edge cases: null, empty or broken html gives what text can be found, or an empty text; an
unclosed tag, comment, script or quote ends with the page, but an unclosed title, noscript,
template, iframe or svg is empty, as is a svg that closes itself; a null url or one without a host is
the host ""; repeated rows give a row each; an empty table gives an empty result; extra columns
are ignored; long pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm.common import saved

DAMPING = 0.9
LEAST_IMPORTANCE = 0.15
LEAST_PAGES = 5
BROADCAST_ROWS = 100_000
#: Blocks that tell a page from copies of another.
IDENTITY = 3

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose start closes an open element of these kinds, within the nearest scope.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("html body article section main div table ul ol dl td th blockquote aside nav header footer form".split())
# Elements, roles and words of classes that never hold an article's text.
NEVER = frozenset(
    "head script style noscript template iframe svg math canvas object audio video nav footer aside form button select"
    " textarea dialog menu title datalist input".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus"
    " reply replies respond responses discussion tags share sharing social related recommended newsletter subscribe subscription signup login popup"
    " modal overlay widget toolbar copyright skip pagination pager".split()
)
OUTSIDE = frozenset(("header", "topbar"))
#: Words for elements that hold other articles, or comments marked up as articles.
OTHERS = frozenset("related recommended promo promotion sponsor sponsored comment comments disqus reply replies respond responses discussion".split())

#: Elements whose text is raw up to their end tag; those of `OPEN_ENDED` are empty if there is none.
RAW = tuple("script style textarea title noscript template iframe svg".split())
OPEN_ENDED = frozenset("title noscript template iframe svg".split())


@cache
def _token(unclosed: frozenset[str]) -> re.Pattern:
    """The tokens of a page, where the elements `unclosed` have no end tag."""
    return re.compile(
        rf"""<!--.*?(?:-->|\Z)
    |<svg\b(?>[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+/>
    |<({"|".join(t for t in RAW if t not in unclosed)})\b(?>[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\b[^>]*>|(\Z))
    |<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
        re.S | re.I | re.X,
    )


def tokens(html: str) -> Iterator[re.Match]:
    unclosed, at = frozenset(), 0
    while True:
        for m in _token(unclosed).finditer(html, at):
            if m[1] and m[2] is not None and m[1].lower() in OPEN_ENDED:
                # no end tag from here on: read again from this tag, which is now an empty element
                unclosed, at = unclosed | {m[1].lower()}, m.start()
                break
            yield m
        else:
            return


ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    """An open element; `named` holds the numbers of the elements with words of noise around it."""

    __slots__ = ("tag", "path", "noise", "main", "children", "named")

    def __init__(self, tag: str, path: int, noise: bool, main: bool) -> None:
        self.tag, self.path, self.noise, self.main, self.children, self.named = tag, path, noise, main, [], ()


class Block:
    """A run of text between block-level tags: the elements it is in, and its text."""

    __slots__ = ("paths", "text", "main")

    def __init__(self, paths: tuple[int, ...], text: str, main: bool) -> None:
        self.paths, self.text, self.main = paths, text, main


#: What a class or id says of an element: nothing, a word of noise among others, one that names
#: other articles, or a name that is a word of noise itself.
PLAIN, WORD, OTHER, NAME = range(4)


def _open(tag: str, attributes: str, parent: Element | None, known: dict) -> tuple[Element, int, bool]:
    """The element, what its names say, and whether it is the page's main element."""
    up, in_main, noise = (parent.path, parent.main, parent.noise) if parent else (0, False, False)
    key = (tag, attributes, up, in_main, noise)
    if key in known:
        path, is_noise, main, sign, whole = known[key]
        return Element(tag, path, is_noise, main), sign, whole
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = {w.lower() for k in ("class", "id") for w in PARTS.split(found.get(k, "")) if w}
    role = found.get("role", "").lower()
    noise = noise or tag in NEVER or role in ROLES
    noise = noise or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    if not in_main:
        noise = noise or tag == "header"
    sign = PLAIN
    if tag in ("html", "body", "main", "article"):  # a page's class may hold any of the words
        noise = (parent.noise if parent else False) or (tag == "article" and bool(words & {"comment", "comments", "reply", "related"}))
    elif bad := words & (WORDS if in_main else WORDS | OUTSIDE):
        names = {n for k in ("class", "id") for n in found.get(k, "").lower().split()}
        sign = NAME if names & bad else OTHER if bad & OTHERS else WORD
    whole = not noise and (tag == "main" or role == "main" or found.get("itemprop") == "articleBody")
    main = not noise and (in_main or whole or tag == "article")
    style = " ".join(sorted(found.get("class", "").lower().split()))
    path = xxhash.xxh3_64_intdigest(f"{up} {tag} {style}") - (1 << 63)
    if len(known) > 50_000:
        known.clear()
    known[key] = (path, noise, main, sign, whole)
    return Element(tag, path, noise, main), sign, whole


def _named(signs: list[int], holds_main: set[int], holds_article: set[int], texts: list[tuple[int, tuple[int, ...], bool]]) -> set[int]:
    """The elements with words of noise that are noise, by number. `texts` has the length of each
    text, the numbers of the elements it is in, and whether it is in an article.

    An element is not if it holds the main element, an article or more than half of the page's
    text; what lies inside an article does not count as holding it. If it names other articles, text in an article does not count and none may be
    outside; if one of its names is such a word itself, only the main element counts. If that
    leaves nothing of a page that has text, or nothing of the articles where these are most of it,
    the words say nothing.
    """
    every, article = [0] * len(signs), [0] * len(signs)
    total = total_article = free = free_article = 0
    for n, within, main in texts:
        total += n
        total_article += n * main
        for i in within:
            every[i] += n
            article[i] += n * main
    def layout(i: int, sign: int) -> bool:
        most = 2 * every[i] > total
        return i in holds_main or sign == WORD and (most or i in holds_article) or sign == OTHER and most and article[i] == total_article

    noise = {i for i, sign in enumerate(signs) if not layout(i, sign)}
    for n, within, main in texts:
        if noise.isdisjoint(within):
            free += n
            free_article += n * main
    if total and not free:
        return set()
    if total_article and not free_article and total_article > free:
        return {i for i in noise if not article[i]}
    return noise


def parse(html: str, known: dict | None = None) -> tuple[list[Block], dict[int, list[tuple[str, ...]]]]:
    """The text blocks of a page that are not noise by their names, and each element's child
    sequences by path (runs of one tag count once)."""
    known = {} if known is None else known
    stack: list[Element] = []
    blocks: list[Block] = []
    styles: dict[int, list[tuple[str, ...]]] = {}
    buffer: list[tuple[str, tuple[int, ...]]] = []
    found: list[tuple[tuple[int, ...], list[tuple[str, tuple[int, ...]]], bool]] = []
    seen: list[Element] = []
    signs: list[int] = []
    holds_main: set[int] = set()
    holds_article: set[int] = set()
    has_main = False

    def flush() -> None:
        if buffer:
            top = stack[-1] if stack else None
            found.append((tuple(e.path for e in stack if e.tag not in INLINE), buffer.copy(), bool(top and top.main)))
            buffer.clear()

    def pop() -> None:
        e = stack.pop()
        if e.children and not e.noise and e.tag not in INLINE:
            seen.append(e)

    def add(text: str) -> None:
        buffer.append((text, stack[-1].named if stack else ()))

    def close(tags: tuple[str, ...], scoped: bool) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if scoped and stack[i].tag in SCOPES:
                return

    at = 0
    for m in tokens(html):
        if m.start() > at and not (stack and stack[-1].noise):
            add(html[at : m.start()])
        at = m.end()
        tag = m[4] or m[7]
        if not tag:
            if not m[0].startswith(("<!", "<?")):  # raw text: nothing of it is an article's, but it ends a word
                add(" ")
            continue
        tag = tag.lower()
        if m[3] or m[6]:
            if tag not in INLINE:
                flush()
                close((tag,), tag == "p" or tag == "li")
            elif any(e.tag == tag for e in stack[-8:]) and stack[-1].tag in INLINE:
                close((tag,), False)
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES:
                # an open inline element ends with the block that it is in
                for _ in range(len(CLOSES[tag])):
                    close(CLOSES[tag], True)
            if stack and not stack[-1].noise:
                up = next((e for e in reversed(stack) if e.tag not in INLINE), None)
                if up and (not up.children or up.children[-1] != tag):
                    up.children.append(tag)
        if tag in VOID or tag in OPEN_ENDED or tag == "path" and (m[5] or m[8] or "").rstrip().endswith("/"):
            continue
        e, sign, whole = _open(tag, m[5] or m[8] or "", stack[-1] if stack else None, known)
        e.named = stack[-1].named if stack else ()
        if whole:
            has_main = True
            holds_main.update(e.named)
        if e.main and not (stack and stack[-1].main):
            holds_article.update(e.named)
        if sign and not e.noise:
            e.named += (len(signs),)
            signs.append(sign)
        stack.append(e)
    if at < len(html) and not (stack and stack[-1].noise):
        add(html[at:])
    flush()
    while stack:
        pop()
    noise = _named(signs, holds_main, holds_article, [(len(t.strip()), within, main) for _, parts, main in found for t, within in parts]) if signs else set()
    for paths, parts, main in found:
        # references are decoded after tags are gone; split() knows all white space
        text = " ".join(unescape("".join(t for t, within in parts if not within or noise.isdisjoint(within))).split())
        if text:
            blocks.append(Block(paths, text, main))
    for e in seen:
        if noise.isdisjoint(e.named):
            styles.setdefault(e.path, []).append(tuple(e.children))
    inside = [b for b in blocks if b.main]
    # articles without a main element may be teasers beside the text: they must hold most of it, or
    # the longest block
    if inside and not has_main:
        within, longest = sum(len(b.text) for b in inside), max(len(b.text) for b in inside)
        if 2 * within < sum(len(b.text) for b in blocks) and any(len(b.text) > longest for b in blocks):
            inside = []
    blocks = inside or blocks
    return blocks, styles


def tree_rows(pages: DataFrame) -> DataFrame:
    """(host, page, path, style, digest): each element's child sequences and texts on a page.
    A text counts for the elements it is in; `page` is the digest of the page's `IDENTITY` longest
    blocks, so that one long block that all pages of a host share does not make them one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), set()
                out: list[tuple] = []
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    blocks, styles = parse(html or "", known)
                    if not blocks:
                        continue
                    host = host_of(url)
                    longest = sorted({b.text for b in blocks}, key=lambda t: (-len(t), t))[:IDENTITY]
                    page = xxhash.xxh3_64_intdigest("\n".join(longest)) - (1 << 63)
                    rows = {
                        (path, False, text_key(path, b.text), i + 1 == len(b.paths))
                        for b in blocks for i, path in enumerate(b.paths)
                    }
                    rows |= {(path, True, xxhash.xxh3_64_intdigest("/".join(s)) - (1 << 63), False) for path, found in styles.items() for s in found}
                    out.extend((host, page, *r) for r in rows)
                if out:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["host", "page", "path", "style", "digest", "leaf"]
                    )

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "host string, page long, path long, style boolean, digest long, leaf boolean"
    )


def text_counts(rows: DataFrame) -> DataFrame:
    """(host, path, style, digest, n, leaf): over how many distinct pages a text or sequence occurs."""
    # the same text or sequence at the same place of two pages with one digest counts once
    seen = rows.groupBy("host", "path", "style", "digest", "page").agg(F.max("leaf").alias("leaf"))
    return seen.groupBy("host", "path", "style", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("leaf").alias("leaf"))


def importance(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(host, path, pages, importance) of every element of the style trees; `counts` are the
    `text_counts` of the rows, if they are there already."""
    counts = text_counts(rows) if counts is None else counts
    m = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("style"), n * F.log(n))).alias("text_log"),
        F.sum(F.when(~F.col("style"), n)).alias("texts"),
        F.sum(F.when(F.col("style"), n * F.log(n))).alias("style_log"),
        F.sum(F.when(F.col("style"), n)).alias("style_n"),
        F.count(F.when(F.col("style"), 1)).alias("styles"),
        F.max(F.col("leaf") & ~F.col("style")).alias("leaf"),
    )
    base = F.log(F.col("pages").cast("double"))
    content = 1 - F.try_divide(F.col("text_log"), F.col("texts") * base)
    # the entropy of the sequences, each with its share of the pages
    look = F.try_divide(F.log("style_n") - F.col("style_log") / F.col("style_n"), base)
    content, look = F.coalesce(content, F.lit(1.0)), F.coalesce(look, F.lit(0.0))
    weight = F.pow(F.lit(DAMPING), F.col("styles").cast("double"))
    value = F.when(F.col("leaf") | (F.col("styles") == 0), content).otherwise((1 - weight) * look + weight * content)
    return sums.join(m, "host").select("host", "path", "pages", F.greatest(value, F.lit(0.0)).alias("importance"))


def text_key(path: int, text: str) -> int:
    """The digest of a text at an element."""
    return xxhash.xxh3_64_intdigest(f"{path} {text}") - (1 << 63)


def noise(pages: DataFrame) -> DataFrame:
    """(host, key): of each host, the elements that hold only texts of low importance, and the
    keys of low texts in elements that are low in the mean."""
    rows = tree_rows(pages)
    counts = saved(text_counts(rows))
    found = importance(rows, counts).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    # a row for each element that is low: few, and split by AQE where one has very many texts
    texts = counts.filter(F.col("leaf") & ~F.col("style")).join(found.select("host", "path", "pages"), ["host", "path"])
    low = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double")) < LEAST_IMPORTANCE
    # at most pages ^ LEAST_IMPORTANCE low texts for each text that a page has there
    elements = texts.groupBy("host", "path").agg(F.collect_list(F.when(low, F.col("digest"))).alias("low"), F.count(F.when(~low, 1)).alias("others"))
    return elements.select("host", F.explode(F.when(F.col("others") == 0, F.array("path")).otherwise(F.col("low"))).alias("key")).distinct()


def _keys(block) -> tuple[int, ...]:
    """The keys under which a block may be removed."""
    return (block.paths[-1], text_key(block.paths[-1], block.text)) if block.paths else ()


def drops(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """(host, page, keys): the keys of `removed` (host, key) that each of `pages` (host, page, html)
    holds: as many as it has blocks, however many its host has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pydict()
                rows = [
                    (host, page, key)
                    for host, page, html in zip(part["host"], part["page"], part["html"])
                    for key in {k for b in parse(html, known)[0] for k in _keys(b)}
                ]
                if rows:
                    kinds = pa.string(), pa.string(), pa.int64()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["host", "page", "key"])

    held = pages.select("host", "page", "html").mapInArrow(run, "host string, page string, key long")
    return held.join(removed, ["host", "key"]).groupBy("host", "page").agg(F.collect_set("key").alias("keys"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    removed = saved(noise(pages))
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    of_hosts = None
    if removed.count() <= BROADCAST_ROWS:
        found: dict[str, set[int]] = {}
        for host, key in removed.select("host", "key").collect():
            found.setdefault(host, set()).add(key)
        of_hosts = pages.sparkSession.sparkContext.broadcast(found)
        rows = rows.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
        rows = rows.withColumn("host", host).withColumn("page", F.md5(F.coalesce("html", F.lit(""))))
        some = drops(rows.filter("html is not null"), removed)
        rows = rows.join(some, ["host", "page"], "left").select("page_id", "url", "html", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        nothing: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, texts = batch.slice(at, 512), []
                for url, html, keys in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    drop = of_hosts.value.get(host_of(url), nothing) if of_hosts else set(keys or ())
                    texts.append("\n".join(b.text for b in parse(html or "", known)[0] if drop.isdisjoint(_keys(b))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
