"""Operator 5: main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by where they stand (the
tags, classes and ids around them), tags score below zero, and one linear scan
finds the contiguous region of the highest sum.  The weights are log-odds
learned from labelled pages: those that mark their main text with <article> or
<main>.  Pages without such a mark, or whose marked elements hold no words but
those of comments and the like, are scored by the same weights.

Inside the region, runs of text in elements of a clearly negative weight
(adverts, comments, forms and the like) are masked, and the rest is returned in
blocks.  One pass over the pages, no shuffle; only the weights, learned on at
most ``max_train`` labelled pages, go through the driver.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_table

#: Most labelled pages that weights are learned on (those with the smallest hash of their id).
MAX_TRAIN = 2_000

# Elements and name parts of HTML, as given before any page is seen.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "select")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
MAIN = ("article", "main")
BAD_TAGS = ("nav", "aside", "footer", "header", "form", "button", "menu", "dialog", "head", "fieldset", "option")
BAD_NAMES = ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
GOOD_NAMES = ("article", "p", "main", "h1", "h2", "h3", "h4", "blockquote", "pre", "content", "entry", "post", "story")

#: Runs of text that the lists above stand for, so that some more in labelled pages decide.
PSEUDO = 20.0
DECISIVE = -1.0
TAG_SCORE = -0.25
#: Score of a masked word outside the main text, and of any word outside it on a page that marks it.
MASKED = -0.5
OUTSIDE = -3.0
#: An element with such a share of the page's words and one of these elements in it wraps the page; its names mask nothing.
#: Nor do those of one with such a share of the words in main elements, be it around them or in them.
WRAPS = 0.9
LANDMARKS = ("h1", "main", "nav")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose id is an anchor in the text and says nothing of what they hold.
ANCHORED = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "td", "th", "li")
_ANCHOR = re.compile(r"""(?:^|\s)id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_STATE = re.compile(r"(?:has|with|no|without)[-_]")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _parts(name: str) -> list[str]:
    """Parts of a class, id or role; one that says what is around ("has-sidebar") stays whole."""
    return [name] if _STATE.match(name) else _PART.findall(name)


def runs(page: str) -> Iterator[tuple[str, bool, tuple[frozenset[str], ...], bool]]:
    """(text or tag name, whether it is text, features of the elements around it, whether a tag breaks a block), in page order."""
    stack: list[tuple[str, frozenset[str]]] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield page[at : m.start()], True, tuple(f for _, f in stack), False
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] is not None:
                yield m["raw"].lower(), False, (), m["raw"].lower() in ("title", "textarea", "select")
            continue
        if m["close"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            if tag in _CLOSES_P:  # a paragraph ends where another block begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag == "li" and any(t == "li" for t, _ in stack):
                k = max(i for i, (t, _) in enumerate(stack) if t == "li")
                if not any(t in ("ul", "ol", "menu") for t, _ in stack[k:]):
                    del stack[k:]
            if tag not in VOID and not m["rest"].endswith("/"):
                names = {"." + p for g in _NAMES.findall(_ANCHOR.sub(" ", m["rest"]) if tag in ANCHORED else m["rest"]) for w in "".join(g).lower().split() for p in _parts(w)}
                stack.append((tag, frozenset(names | {tag})))
        # a button stands in a sentence like a word, though its own is masked
        yield tag, False, (), tag not in INLINE and tag != "button"
    if at < len(page):
        yield page[at:], True, tuple(f for _, f in stack), False


def _inside(around: tuple[frozenset[str], ...]) -> bool:
    return any(f & set(MAIN) for f in around)


def _labelled(around: tuple[frozenset[str], ...]) -> bool:
    """Whether text there is in a main element that neither is nor stands in one given as boilerplate."""
    for names in around:
        if not names & {"html", "body"} and any(_prior(n)[1] > 1.0 for n in names):
            return False
        if names & set(MAIN):
            return True
    return False


def _prior(name: str) -> tuple[float, float]:
    bare = name.lstrip(".")
    if name in BAD_TAGS or name.startswith(".") and bare in BAD_NAMES:
        return 1.0, PSEUDO
    return (PSEUDO, 1.0) if bare in GOOD_NAMES else (1.0, 1.0)


def learn_counts(page: str) -> Counter:
    """Runs of text with each feature, inside and outside the main text; none of a page without one."""
    counts: Counter = Counter()
    for text, is_text, around, _ in runs(page):
        if is_text and text.strip():
            for name in set().union(*around):
                counts[name, _labelled(around)] += 1
    return counts if any(inside for _, inside in counts) else Counter()


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_train: int = MAX_TRAIN) -> dict[str, float]:
    """Log-odds of each element and name part for text inside a main element.

    Without labelled pages only the values given beforehand remain.
    """
    marked = "(?i)<(article|main)[\\s>]"
    labelled = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike(marked))
    labelled = labelled.filter(F.regexp_replace("html", "(?is)<!--.*?-->|<(script|style|template|textarea)\\b.*?</\\1\\s*>", " ").rlike(marked))
    # first the ids alone, then only their pages
    ids = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_train)
    chosen = labelled.join(F.broadcast(ids), "id").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(learn_counts(page))
        names = sorted({n for n, _ in total})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n, True] for n in names], pa.int64()), pa.array([total[n, False] for n in names], pa.int64())], ["name", "inside", "outside"])

    rows = chosen.mapInArrow(run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    counts = {r["name"]: (r["i"], r["o"]) for r in rows}
    names = set(counts) | {*GOOD_NAMES, *BAD_TAGS} | {"." + n for n in (*BAD_NAMES, *GOOD_NAMES)}
    out = {}
    for n in names:
        (a, b), (i, o) = _prior(n), counts.get(n, (0, 0))
        out[n] = log((i + a) / (o + b))
    return out


def _decides(name: str, weights: dict[str, float]) -> bool:
    """Whether a name or element stands for boilerplate."""
    return weights.get(name, 0.0) < DECISIVE and (name.startswith(".") or name in BAD_TAGS)


def _word_weight(around: tuple[frozenset[str], ...], weights: dict[str, float], has_main: bool) -> tuple[float, bool]:
    """(score of a word there, whether the text is masked)."""
    inside = False
    soft: list[float] = []
    for names in around:
        if names & set(MAIN):
            inside = True
        for n in names:
            w = weights.get(n, 0.0)
            # a name or element that stands for boilerplate decides; other elements only sway
            if _decides(n, weights) and not (n == "header" and inside):
                return (0.0 if inside else MASKED), True
            soft.append(w)
    if has_main and not inside:
        return OUTSIDE, True
    return 1.0 + max(-0.7, min(2.0, sum(soft) / len(soft) if soft else 0.0)), False


def _spared(parts: list[tuple], weights: dict[str, float]) -> dict[tuple, tuple]:
    """Features around each run of text without those that mask, where the element wraps the page."""
    size: Counter = Counter()
    for text, is_text, around, _ in parts:
        if is_text:
            size[around] += len(text.split())
    words: Counter = Counter()
    marks = set()
    for around, n in size.items():
        for k, names in enumerate(around):
            if any(_decides(x, weights) for x in names):
                words[around[: k + 1]] += n
                if n and any(f & set(LANDMARKS) for f in around[k + 1 :]):
                    marks.add(around[: k + 1])
    most = WRAPS * size.total()
    # words in main elements that no name of theirs masks, and those under each masking element around or in them
    main_words, held = 0, Counter()
    for around, n in size.items():
        at = next((k for k, names in enumerate(around) if names & set(MAIN) and not any(_decides(x, weights) for x in names)), None)
        if at is not None and n:
            main_words += n
            for k, names in enumerate(around):
                # in a main element, a class may say "banner" of what is all of its text; an element like aside means it
                if any(_decides(x, weights) for x in names) and (k < at or not any(_decides(x, weights) for x in names & set(BAD_TAGS))):
                    held[around[: k + 1]] += n

    def own(around: tuple, k: int) -> frozenset[str]:
        names, path = around[k], around[: k + 1]
        if held[path] and held[path] >= WRAPS * main_words:
            return frozenset(n for n in names if not _decides(n, weights))
        if names & {"html", "body"} or path in marks and words[path] >= most:
            return frozenset(n for n in names if not _decides(n, weights) or n in BAD_TAGS and n != "form")
        return names

    return {around: tuple(own(around, k) for k in range(len(around))) for around in size}


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line ends; empty if there is none."""
    parts = list(runs(page))
    spared = _spared(parts, weights)
    parts = [(text, is_text, spared[around] if is_text else around, breaks) for text, is_text, around, breaks in parts]
    open_main = {around for around in spared.values() if _inside(around) and not _word_weight(around, weights, False)[1]}
    if any(is_text and around in open_main and text.strip() for text, is_text, around, _ in parts):
        found = _best_region(parts, weights, True)
        if found:
            return found
    return _best_region(parts, weights, False)


def _best_region(parts: list[tuple], weights: dict[str, float], has_main: bool) -> str:
    items: list[tuple[str | None, bool]] = []  # text to keep (None for a tag or masked text), whether a block ends here
    best = total = 0.0
    best_at, begin = (0, 0), 0
    known: dict[tuple, tuple[float, bool]] = {}
    for text, is_text, around, breaks in parts:
        if is_text:
            if around not in known:
                known[around] = _word_weight(around, weights, has_main)
            weight, masked = known[around]
            gain = weight * len(text.split())
            items.append((None if masked else html.unescape(text), False))
        else:
            gain = TAG_SCORE
            items.append((" " if text == "br" else None, breaks))
        if total <= 0.0:
            total, begin = 0.0, len(items) - 1
        total += gain
        if total > best:
            best, best_at = total, (begin, len(items))
    blocks, now = [], []
    for text, breaks in [*items[best_at[0] : best_at[1]], (None, True)]:
        if text is not None:
            now.append(text)
        if breaks and now:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", *keep: str) -> DataFrame:
    """id, the kept columns, text and n_chars (code points) of each page.

    Null and empty pages have an empty text; repeated rows are extracted again; null ids stay null.
    """
    own = pages.select(F.struct(F.col(id_col).alias("id"), *[F.col(k) for k in keep]).alias("key"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = own.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(p, weights) for p in part.column(1).to_pylist()], pa.string())], ["key", "text"])

    return own.mapInArrow(run, f"key {key}, text string").select("key.*", "text", F.length("text").cast("long").alias("n_chars"))


def op5_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, learn(pages), "page_id", "html", "url").withColumnRenamed("id", "page_id")
