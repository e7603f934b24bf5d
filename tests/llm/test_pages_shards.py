"""HTML extraction on pages with known text, sharding against the published loop."""

import zlib

import pytest
from helpers import awkward_texts, documents, raw

from tablewright.llm import html_text, sharding

LONG = ("The old house of the river was near the hill and it had been there for many years, so "
        "that all of the people who came to see it in the summer had to walk on the green path "
        "with a friend or two.")

RUSSIAN = ("Старый дом у реки стоял недалеко от холма много лет, и поэтому все люди, приезжавшие "
           "летом посмотреть на него, шли по зелёной тропе вместе с другом, а вечером возвращались.")
CHINESE = "河边的老房子在山丘附近矗立了很多年因此所有夏天来参观的人都得沿着绿色的小路与朋友一起走过去" * 4


@pytest.mark.parametrize("page, want", [
    ("", ""), ("just words & more &amp; &lt;b&gt;", "just words & more & <b>"),
    (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>{LONG}<p>Short."
     "</article><footer>&copy; site</footer>", f"Title\n{LONG}\nShort."),
    (f"<div class='cookie-notice'>{LONG}</div><main><p>One.</p><p>{LONG}</p></main>",
     f"One.\n{LONG}"),
    (f"<div id=content><p>{LONG}</p><p>ok</p></div><div class=sidebar><p>{LONG}</p></div>",
     f"{LONG}\nok"),
    ("<article><p>Only short.</p></article><footer>Foot</footer>", "Only short."),
    (f"<article><p>{LONG}</p><section id='comments'><article><p>{LONG}</p></article></section>"
     "</article>", LONG),
    (f"<article><p>{LONG}</p><form><p>Your name</p></form><aside>More</aside></article>", LONG),
    (f"<script>var a = '<p>x</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> -->",
     LONG),
    (f"<article><p>a<b>b</b>c<br>d \n e</p><p>{LONG}</p></article>", f"abc d e\n{LONG}"),
    (f"<article><p>{LONG}</p><p>cut of", f"{LONG}\ncut of"),
    (f"<article><p>{LONG}</p><p", LONG), (f"<article><p>{LONG}</p><a href=\"x", LONG),
    (f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{LONG}</p>"
     "</article>", f"Head\n{LONG}"),
    (f"<p>{LONG}</p><ul>" + "<li><a href=x>One link</a></li>" * 5 + "</ul>", LONG),
    # a language without stop words here, with and without blanks
    (f"<nav><a href=x>Меню</a></nav><div><h1>Дом</h1><p>{RUSSIAN}</p><p>Да.</p></div>"
     "<footer>© сайт</footer>", f"Дом\n{RUSSIAN}\nДа."),
    (f"<ul class=menu><li><a href=x>首页</a></ul><div><p>{CHINESE}</p></div>", CHINESE),
    # a form around the page; a form in the page
    (f"<form><input><div class=top><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
    (f"<form><nav>{LONG}</nav><p>ad text</p><article><p>{LONG}</p></article></form>", LONG),
    (f"<div><p>{LONG}</p></div><form><p>Write to us</p><label>Name</label></form>", LONG),
    # a frame with a telling word in its name
    (f"<div class='page social-layout'><nav>Home</nav><p>{LONG}</p><p>Short.</p>"
     "<div class='share-buttons'><p>Share this</p></div></div>", f"{LONG}\nShort."),
    # names on blocks
    (f"<article><p>{LONG}</p><p class='ad'>{LONG}</p><h2 id=related>More</h2><p>End.</p></article>",
     f"{LONG}\nEnd."),
    # letters that change their length in lower case
    (f"<script>var x = '{'İ' * 40}';</script><p>{LONG}</p><p>a > b</p><p>{LONG}</p>",
     f"{LONG}\na > b\n{LONG}"),
    (f"<script>'</scripted>' + x</SCRIPT ><p>{LONG}</p><style>p</style\n><p>end</p>", f"{LONG}\nend"),
    ("<p title='a > b'>x</p>", "x"), ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_blocks_equal_those_of_the_standard_parser(spark, data):
    """A plain splitter on another parser: the same texts in the same order."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.words, self.hidden = [], [], []

        def close_block(self):
            if text := " ".join("".join(self.words).split()):
                self.found.append(text)
            self.words = []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.DROPPED:
                self.hidden.append(tag)
            self.handle_tag(tag)

        def handle_endtag(self, tag):
            if tag in self.hidden:
                self.hidden.remove(tag)
            self.handle_tag(tag)

        def handle_tag(self, tag):
            if tag == "br":
                self.words.append(" ")
            elif tag in html_text.BLOCK:
                self.close_block()

        def handle_data(self, text):
            if not self.hidden:
                self.words.append(text)

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.close_block()
        assert [b.text for b in html_text.blocks(r.html)] == plain.found


def test_nearest_decided_block_by_bisection_equals_a_full_search():
    import random

    r = random.Random(2)
    for _ in range(200):
        found = [html_text.Block("x", 0, tuple(range(1, 1 + r.randrange(4))), False, False)
                 for _ in range(r.randrange(1, 15))]
        labels = [r.choice([True, False, None, None]) for _ in found]
        want = []
        for i, (b, own) in enumerate(zip(found, labels)):
            decided = [j for j, x in enumerate(labels) if x is not None]
            if own is None and decided:
                shared = lambda j: len(set(b.path) & set(found[j].path))
                own = labels[min(decided, key=lambda j: (-shared(j), abs(i - j), j))]
            want.append(True if own is None else own)
        assert html_text.second_pass(found, labels) == want


def test_extract_table(spark):
    rows = [(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract(df, ["page_id", "url"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_text.extract(df.limit(0), ["url"]).count() == 0


def test_whole_tables_of_pages_hold_their_articles(spark, data):
    import html
    import re

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split())
                 for p in re.split("</?(?:p|h1)>", body))
        assert html_text.main_text(r.html) == "\n".join(p for p in parts if p)


def jump(key, shards):
    key %= 1 << 64
    last, to = -1, 0
    while to < shards:
        last = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((last + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return last


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards(spark, shards):
    rows = awkward_texts() + [(-(1 << 63), "low"), ((1 << 63) - 1, "high"), (-1, "minus")] + [
        (10_000 + i, str(i)) for i in range(200)]
    found = sharding.shard(documents(spark, rows, extra=True), shards).collect()
    want = sorted(((i, len(raw(t)) + 8, zlib.crc32(raw(t)), "key", jump(i or 0, shards),
                    jump(i or 0, shards + 1)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found),
                  key=repr) == want
    for s in range(shards):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in found if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda x: x[1:]) or len({x[1:] for x in own}) < len(own)
    assert all(r.grown_shard in (r.shard, shards) for r in found)


def test_string_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y"), ("b", None)], "doc_id string, text string")
    assert sharding.shard(df, 5).count() == 3
    assert sharding.shard(documents(spark, []), 5).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(documents(spark), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
