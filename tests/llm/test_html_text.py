"""Operator 5 on pages whose main text is known."""

from __future__ import annotations

import html
import itertools
import re

from stridewell.llm import html_text

from .common import DATA

BODY = ["Title of the piece", "First paragraph with <b>bold</b> words &amp; an <a href='/x'>inline link</a> that goes on for a while.", "Second paragraph,\n   broken over   lines, which has &eacute;, &#233; and &#x1F600; in it.", "A third one so that the region is long enough to be found."]
WANT = "Title of the piece\n\nFirst paragraph with bold words & an inline link that goes on for a while.\n\nSecond paragraph, broken over lines, which has é, é and 😀 in it.\n\nA third one so that the region is long enough to be found."
CHROME = {
    "before": "<!doctype html><html><head><title>T</title><style>p{x:y}</style><script>if(a<b)document.write('<p>no</p>')</script></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='cookie-notice'>We use cookies, please accept all of them now.</div>",
    "after": "<div id=comments><p>First! I think this is a comment by a reader.</p></div><aside class=sidebar><p>Related: ten things to read next</p></aside><form><label>Mail</label><input name=m><button>Send</button></form><footer><p>Copyright by nobody, all rights reserved.</p></footer></body></html>",
}


def page(wrap: str) -> str:
    parts = [f"<h1>{BODY[0]}</h1>", *(f"<p>{b}</p>" for b in BODY[1:])]
    middle = parts[0] + parts[1] + "<div class='ad'>Buy this now, it is very cheap today.</div><!-- <p>hidden</p> -->" + "".join(parts[2:])
    return CHROME["before"] + wrap.format(middle) + CHROME["after"]


def learned(spark) -> dict[str, float]:
    return html_text.learn(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_known_pages(spark):
    weights = learned(spark)
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>", "<div id=x><section>{}</section></div>"):
        assert html_text.main_text(page(wrap), weights) == WANT, wrap


def test_marks_count_only_where_they_hold_the_text(spark):
    weights = learned(spark)
    wrap = "<div class=entry-content>{}</div>"
    for before, after in [
        ("", "<article class=comment><p>I think so too, and so does everyone here.</p></article>"),
        ("<script>var s = '<main>';</script>", ""),
        ("<!-- <article> -->", ""),
        ("<main-nav></main-nav><article-card></article-card>", ""),
        ("<main> &nbsp; </main>", ""),
    ]:
        assert html_text.main_text(page(before + wrap + after), weights) == WANT, (before, after)


def test_wrappers_of_the_page_mask_nothing(spark):
    weights = learned(spark)
    for wrap in ("<article>{}</article>", "<div class=content>{}</div>"):
        p = page(wrap)
        assert html_text.main_text(p.replace("<body>", "<body class='has-sidebar sidebar'>"), weights) == WANT
        for names in ("id=page class=with-sidebar", "class=sidebar-left"):
            assert html_text.main_text(p.replace("<body>", f"<body><div {names}>").replace("</body>", "</div></body>"), weights) == WANT, names
    assert html_text.main_text("<body><nav><ul><li>Home<li>News</ul></nav><div class=cookies>Accept all</div></body>", weights) == ""


def test_labelled_pages_decide(spark):
    pages = [(i, "<body><article><div class=banner>" + "<p>words of the piece</p>" * 4 + "</div></article><footer>end</footer></body>") for i in range(20)]
    # what stands in elements of the list is no label of its own
    pages += [(100 + i, "<body><p>text</p><article class=comment><p>me too</p></article></body>") for i in range(60)]
    weights = html_text.learn(spark.createDataFrame(pages, "page_id long, html string"))
    assert weights[".banner"] > 0 and weights[".comment"] < html_text.DECISIVE
    assert html_text.main_text("<body><div class=banner><p>more words of it</p></div></body>", weights) == "more words of it"


def test_pages_of_the_table(spark):
    out = {r.page_id: r for r in html_text.op5_best_region(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        r = out[p.page_id]
        assert r.url == p.url and r.n_chars == len(r.text)
        found = re.search(r"<article>(.*)</article>", p.html, re.S)
        if found:  # without marks and adverts, the words of the article
            inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<(aside|form|nav|div)[^>]*class=\"(ad|share|comments?|related)[^>]*>.*?</\1>", " ", found[1], flags=re.S)
            first = re.search(r"<h1>(.*?)</h1>", inner, re.S)
            if first:
                assert r.text.startswith(" ".join(html.unescape(re.sub("<[^>]*>", " ", first[1])).split())[:20])


def test_the_region_is_the_best_of_all(spark):
    weights = learned(spark)
    p = "<div>short</div><p>" + "many words in here " * 5 + "</p><div class=menu>no no</div><p>more good words to read</p><i>x</i>" + "<td></td>" * 30 + "<p>a far paragraph</p>"
    gains, words = [], []
    for text, is_text, around, _ in html_text.runs(p):
        w, masked = html_text._word_weight(around, weights, False) if is_text else (0, True)
        gains.append(w * len(text.split()) if is_text else html_text.TAG_SCORE)
        words.append([] if masked else text.split())
    best = max(itertools.combinations(range(len(gains) + 1), 2), key=lambda ab: (round(sum(gains[ab[0] : ab[1]]), 9), -ab[0], -ab[1]))
    assert html_text.main_text(p, weights).split() == [w for ws in words[best[0] : best[1]] for w in ws]


def test_odd_pages(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "just words without a tag", "u"), (4, "<p>unclosed <b>bold &amp", "u"), (5, "<!-- only", "u"), (6, "<script>x", "u"), (7, "<p>twice</p>", "u"), (7, "<p>twice</p>", "u"), (None, "<p>no id</p>", None), (8, "<p>" + "long text " * 100_000 + "</p>", "u"), (9, "<<>><p <div>></p>", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string")
    weights = html_text.learn(df)
    out = html_text.extract(df, weights, "page_id", "html", "url").collect()
    of = {r.id: r.text for r in out}
    assert len(out) == 11 and of[1] == of[2] == of[5] == of[6] == ""
    assert of[3] == "just words without a tag" and of[4] == "unclosed bold &" and of[None] == "no id" and of[7] == "twice"
    assert of[8] == ("long text " * 100_000).strip()
    assert html_text.extract(df.filter("false"), weights).count() == 0 and html_text.learn(df.filter("false"))


def test_scripts_and_anchors_leave_sentences_whole(spark):
    weights = learned(spark)
    wrap = "<article><h1>One title</h1><p id='notice-period'>A sentence with <script>track()</script>a script in it, and long enough.</p><h2 id=related-work>Related work</h2><p>What others did before, in some more words.</p></article>"
    assert html_text.main_text(page(wrap), weights) == "One title\n\nA sentence with a script in it, and long enough.\n\nRelated work\n\nWhat others did before, in some more words."


PROSE = "The river runs past the old mill and turns south before it meets the road again at noon."


def test_names_of_what_holds_the_main_text_mask_nothing(spark):
    weights = learned(spark)
    for layout in (
        f"<body><div class='header-fixed layout'><article><p>{PROSE}</p></article></div></body>",
        f"<body><article><div class='related-work'><p>{PROSE}</p></div></article></body>",
        f"<body><article><div class='banner-image'><p>{PROSE}</p></div></article></body>",
        f"<body><nav><ul><li>a<article><p>{PROSE}</p></article></body>",
        f"<body><div class='has-sidebar sidebar-layout'><nav><a href=/>Home</a></nav><main><p>{PROSE}</p></main><div class=sidebar><p>Read next</p></div></div></body>",
    ):
        assert html_text.main_text(layout, weights) == PROSE, layout
    # what isn't most of the main text, or is a comment, or an aside of its own, still goes
    for layout, want in (
        (f"<body><article><p>{PROSE}</p><p>{PROSE}</p><div class='related-work'><p>Read this next.</p></div></article></body>", f"{PROSE}\n\n{PROSE}"),
        (f"<body><div class=comments><article class=comment><p>{PROSE}</p></article></div></body>", ""),
        (f"<body><main><aside><p>{PROSE}</p></aside></main></body>", ""),
    ):
        assert html_text.main_text(layout, weights) == want, layout


def test_a_button_in_a_sentence_does_not_end_it(spark):
    assert html_text.main_text(f"<body><article><p>{PROSE}</p><p>Press <button>OK</button> now.</p></article></body>", learned(spark)) == f"{PROSE}\n\nPress now."
