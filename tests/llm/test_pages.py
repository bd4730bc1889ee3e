from __future__ import annotations

import re
from html import unescape

import pytest

from orderlens.llm import pages
from orderlens.llm.common import table

SCHEMA = "page_id long, url string, html string, text string"


def extracted(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA)
    return sorted(((r.page_id, r.text, r.n_chars) for r in pages.extract(df, **options).collect()), key=repr)


def test_structure(spark):
    rows = [
        (1, "http://h/a", "<p>x &amp; y<div class=ad>no</div><p>z<br>w <b>bold</b>t</p><nav>n<ul><li>a</nav>end"),
        (2, "", "<article><header><h1>T</h1></header><p>body &lt;b&gt; &nbsp;\n c</p><div id='comments-list'><p>c1</div>"
                "<section class=\"reader comments\">c2</section><footer>f</footer></article><p>out"),
        (3, "http://h/b", "<script>if(a<b){'</p>'}</script>a < b <img alt='x>y'>&copy;<!-- c --><style>p{}</style><form>f"),
        (4, None, "<div hidden>h</div><div style='display: none'>i</div><main><table><tr><td>1<td>2<tr><td>3</table></main>"),
        (5, "http://h/c", "<title>t</title><ul><li>a<li>b<p>c</ul><aside>s<p>s</aside>d"),
    ]
    want = [
        (1, "x & y\nz\nw boldt\nend"), (2, "T\nbody <b> c"), (3, "a < b ©"), (4, "1\n2\n3"), (5, "a\nb\nc\nd"),
    ]
    assert extracted(spark, rows) == [(i, t, len(t)) for i, t in want]


@pytest.mark.parametrize("around", [
    '<div class="content has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="search-enabled">',
    '<div class="sidebar">', '<div id="main-menu"><div class="Widget">', '<section class="withComments">',
])
def test_names_around_an_article_do_not_drop_it(around):
    assert pages.blocks_of(f'{around}<nav>n</nav><article><p>real text</p></article><p>x</p></div>') == (["real text"], True)
    assert pages.blocks_of(f'{around}<main>real text</main><div class="ad">x</div>') == (["real text"], True)


@pytest.mark.parametrize("part", [
    '<section id="discussion">real</section>', '<h2 id="related-work">real</h2>', '<div class="ad-hoc">real</div>',
    '<p class="notice">real</p>', '<h2 id="comments">real</h2>', '<div class="no-comments">real</div>',
])
def test_ordinary_names_inside_an_article_stay(part):
    assert pages.blocks_of(f"<article><p>a</p>{part}<p>b</p></article>") == (["a", "real", "b"], True)


@pytest.mark.parametrize("part", [
    '<div class="ad">x</div>', '<div id="sidebar">x</div>', '<section class="related-posts">x</section>',
    '<div class="commentList">x</div>', '<div role="search">x</div>', '<section id="comments"><article>x</article></section>',
])
def test_boilerplate_inside_and_behind_an_article_goes(part):
    assert pages.blocks_of(f"<article><p>a</p>{part}<p>b</p></article>") == (["a", "b"], True)
    assert pages.blocks_of(f"<article>a</article>{part}") == (["a"], True)


def test_names_on_pages_without_an_article():
    page = '<div class="has-sidebar"><p>a <span class="ad">x</span>b</p><div class="top-menu">x</div></div>'
    assert pages.blocks_of(page) == (["a b"], False)


@pytest.mark.parametrize("html", [None, "", "<", "<a", "<p", "</", "<!--", "<script>", "&#", "<p " + "'" * 50, "<div>" * 3000])
def test_broken_html_has_no_text(spark, html):
    texts = {r[1] for r in extracted(spark, [(1, None, html)])}
    assert texts <= {"", "<", "</", "&#"}


def test_shared_runs_go_where_no_article_is_marked(spark):
    menu = "<div>home news sport weather local about us contact legal</div>"
    rows = [(i, "http://h/x", f"{menu}<div>only page {i} says things like number {i * 17}</div>") for i in range(6)]
    assert [t for _, t, _ in extracted(spark, rows)] == [f"only page {i} says things like number {i * 17}" for i in range(6)]
    alone = [(i, f"http://host{i}/", h) for i, _, h in rows]
    assert all("weather" in t for _, t, _ in extracted(spark, alone))


def test_copies_and_shared_passages_stay(spark):
    passage = "this passage of more than eight words is quoted by several pages of the host"
    rows = [(i, "http://h/x", f"<article><p>{passage}</p><p>page {i} goes on by itself in its own way {i}</p></article>") for i in range(8)]
    assert all(passage in t for _, t, _ in extracted(spark, rows))
    copies = [(i, "http://h/x", "<div>" + passage + "</div>") for i in range(30)]
    assert {t for _, t, _ in extracted(spark, copies)} == {passage}


def test_host_wide_notice_in_articles_goes(spark):
    notice = "we would like to remind all of our visitors to read the rules before they write"
    rows = [(i, "http://h/x", f"<article><p>story {i} about thing {i * 31} and so on and on {i}</p><p>{notice}</p></article>") for i in range(40)]
    assert all(t.startswith("story") and notice not in t for _, t, _ in extracted(spark, rows))


@pytest.mark.parametrize("shard_bytes", [1 << 9, 1 << 11, 1 << 22])
def test_pages_are_counted_over_the_whole_host(spark, shard_bytes):
    menu = "<div>home news sport weather local about us contact legal</div>"
    pair = "<div>this pair of pages alone shares a line of so many words</div>"
    rows = [(i, "http://h/x", f"{menu if i < 12 else ''}{pair if i in (3, 25) else ''}<div>only page {i} says things like number {i * 17}</div>") for i in range(40)]
    rows += [(100 + i, "http://h/x", rows[30][2]) for i in range(30)]
    want = {i: f"only page {i if i < 100 else 30} says things like number {(i if i < 100 else 30) * 17}" for i, _, _ in rows}
    assert {i: t for i, t, _ in extracted(spark, rows, shard_bytes=shard_bytes)} == want


@pytest.mark.parametrize("shard_bytes", [1 << 9, 1 << 11, 1 << 22])
@pytest.mark.parametrize("noticed", [23, 24])
def test_widespread_is_a_share_of_the_host_without_copies(spark, shard_bytes, noticed):
    notice = "we would like to remind all of our visitors to read the rules before they write"
    story = "<p>story {0} about thing {1} and so on and on {0}</p>"
    rows = [(i, "http://h/x", f"<article>{story.format(i, i * 31)}<p>{notice if i < noticed else f'page {i} has no such words'}</p></article>") for i in range(40)]
    rows += [(100 + i, "http://h/x", rows[39 * (i % 2)][2]) for i in range(30)]
    got = [notice in t for i, t, _ in extracted(spark, rows, shard_bytes=shard_bytes) if i < noticed]
    assert got == [noticed < 0.6 * 40] * noticed


def test_a_page_of_shared_blocks_alone_is_no_copy(spark):
    menu = "<div>home news sport weather local about us contact legal</div>"
    rows = [(1, "http://h/x", menu), (2, "http://h/x", menu + "<div>some words</div>"), (3, "http://h/x", menu + "<div>other</div>")]
    assert [t for _, t, _ in extracted(spark, rows)] == ["", "some words", "other"]


def test_runs_by_brute_force():
    import random

    rnd = random.Random(3)
    docs = [[" ".join(rnd.choices("abcd", k=rnd.randint(1, 12))) for _ in range(rnd.randint(0, 4))] for _ in range(25)]
    spreads, distinct = pages.repeated(docs, 4)
    streams = [[t for b in d for t in b.split(" ")] for d in docs]
    unique = list(dict.fromkeys(map(tuple, docs)))
    assert distinct == len(unique)
    flat = [[t for b in d for t in b.split(" ")] for d in unique]
    for stream, spread in zip(streams, spreads, strict=True):
        for i in range(len(stream)):
            runs = [stream[a : a + 4] for a in range(max(0, i - 3), i + 1) if a + 4 <= len(stream)]
            most = max((sum(any(s[k : k + 4] == r for k in range(len(s))) for s in flat) for r in runs), default=1)
            assert max(1, spread[i]) == most


def test_given_pages_against_their_markup(spark):
    """The article of the given pages, read off their markup."""
    df = table(spark, "/root/testdata/sf0.01", "pages")
    source = {r.page_id: r.html for r in df.collect()}
    rows = pages.extract(df, shard_bytes=1 << 16).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wrappers_around_an_article_lose_nothing():
    story = "<article><p>Hello world</p></article>"
    for html in (
        f'<form id="aspnetForm">{story}<input type=submit><button>Go</button></form>',
        f"<header>{story}</header>", f"<dialog open>{story}</dialog>", f"<fieldset><object>{story}</object></fieldset>",
    ):
        assert pages.blocks_of(html) == (["Hello world"], True), html
    assert pages.blocks_of("<main><fieldset><p>kept</p></fieldset><form><p>Your name</p></form></main>") == (["kept"], True)
    assert pages.blocks_of("<form><p>Your name</p></form><header>Site</header><p>text</p>") == (["text"], False)


def test_cards_are_not_the_main_part():
    story = " ".join(f"word{i}" for i in range(60))
    html = f'<article class="card"><h2>Teaser</h2></article><div id="content"><p>{story}</p></div>'
    assert pages.blocks_of(html) == (["Teaser", story], False)
    assert pages.blocks_of(f"<p>Short line</p><article><p>{story}</p></article>") == ([story], True)


def test_broken_html_of_a_megabyte_is_quick():
    import time

    begin = time.process_time()
    for html in ("<b>" * 150_000 + "</i>" * 150_000, "<b>" * 100_000 + "<div>x</div>" * 60_000,
                 "<li>" * 100_000 + "</ul>" * 100_000, "<p>" * 150_000 + "</p>" * 150_000):
        pages.blocks_of(html)
    assert time.process_time() - begin < 40
