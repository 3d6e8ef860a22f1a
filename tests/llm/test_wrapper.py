from __future__ import annotations

import html
import re
import time
from functools import lru_cache

import pytest

from tideweave.llm import wrapper


def expected(source):
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1])
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)
    return "\n".join(x for x in lines if x)


def test_supplied_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = wrapper.op7_html_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.url == pages[r.page_id].url and r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text)


def test_joined_by_host_gives_the_same(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, wrapper.extract(pages, broadcast_bytes=0).collect())) == sorted(map(tuple, wrapper.extract(pages).collect()))


def make(i, body):
    return f"""<html><head><title>t{i}</title><style>p{{}}</style></head><body><header class="site-header"><div>Site name</div><form><input><p>Search</p></form></header>
      <div class="menu"><a href=x>Home</a><a>About {i}</a></div><div id="wrap"><div class="col">{body}</div><aside>See also {i}</aside></div>
      <div class="cookie-notice"><p>We use cookies {i}</p></div><section id="comments"><p>Nice one, says reader {i}</p></section><footer>&copy; {i}</footer></body></html>"""


def test_slots_without_landmarks(spark):
    rows = [(i, f"https://Host.example/{i}", make(i, f"<h2>Title {i}</h2><p>First &amp; words {i}<p>second<br>line {i}<ul><li>one {i}<li>two</ul><script>no()</script>")) for i in range(6)]
    rows += [(10, "https://other/1", None), (11, None, "<p>Alone&nbsp; here</p>"), (12, "https://other/2", ""), (13, "https://other/3", "<main><p>a<p>b</main><nav>c</nav>"), (0, rows[0][1], rows[0][2])]
    out = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "'h' AS host")).collect()}
    for i in range(6):
        assert out[i].text == f"Title {i}\nFirst & words {i}\nsecond line {i}\none {i}\ntwo"
    assert out[10].text == "" and out[12].text == "" and out[11].text == "Alone here" and out[13].text == "a\nb"


def test_constant_text_between_slots_is_template(spark):
    """Without landmarks and role words: two slots far apart are content, what stands the same around them is not."""
    page = lambda i: f"""<html><body><div class="brand">Daily Example</div><div class="wrap"><div class="col"><h2>Title {i}</h2><p>Words of page {i}</p><p>and more {i * 7}</p></div>
      <div class="rail"><h3>Most read</h3><p>Other story {i + 1}</p></div></div><div class="imprint">Example Ltd, <b>1 Road</b></div></body></html>"""  # noqa: E731
    rows = [(i, f"https://plain.example/{i}", page(i)) for i in range(12)]
    rows.append((12, "https://plain.example/12", page(12).replace("Daily Example", "Sunday Example")))
    out = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i] == f"Title {i}\nWords of page {i}\nand more {i * 7}\nOther story {i + 1}"
    assert out[12].startswith("Sunday Example\nTitle 12\n") and "Ltd" not in out[12]


def test_empty(spark):
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("source", ["<", "<<<>", "<a", "</p></div>", "<!-- never", "<script>x", "<p " + 'a="' * 50, "<div>" * 3000 + "x" + "</div>" * 3000, "&amp &#x41; &#0; &bogus;", "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_broken_markup(source):
    page = wrapper.Page(source)
    m = wrapper.Matcher()
    m.shape(page)
    assert m.match(page, page)[0] == 0
    assert isinstance(page.text([0]), str)


def test_simple_tree_matching_is_optimal():
    a = wrapper.Page("<div><p><b>1</b></p><ul><li>2</li><li>3</li></ul><p>4</p></div><div class=x><p>5</p></div>")
    b = wrapper.Page("<div><ul><li>2</li></ul><p><i>9</i></p><p>4</p><p>6</p></div><h1>t</h1><div class=x><p><b>5</b></p></div>")
    m = wrapper.Matcher()
    m.shape(a)
    m.shape(b)
    ka, kb = wrapper._children(a), wrapper._children(b)

    @lru_cache(None)
    def best(x, y):
        if a.labels[x] != b.labels[y]:
            return 0

        @lru_cache(None)
        def rest(i, j):
            if i == len(ka[x]) or j == len(kb[y]):
                return 0
            return max(rest(i + 1, j), rest(i, j + 1), best(ka[x][i], kb[y][j]) + rest(i + 1, j + 1))

        return 1 + rest(0, 0)

    assert m.weight(a.shape[0], b.shape[0]) == best(0, 0) == len(m.match(a, b))


def texts(spark, rows):
    return {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_article_parts_that_are_named_like_page_parts_stay():
    page = """<body><div class="social-links">Share it</div><article><h1>T</h1><h2 id="related-work">Related work</h2><section id="search"><p>How we search</p></section>
      <div class="social-policy"><p>On policy</p></div><p>Formula <math><mi>x</mi></math> in <svg><text>a figure</text></svg> and <object>what stands for it</object></p>
      <div class="ad">Buy</div><ol class="comments"><li>First!</li></ol><div id="comments">Second!</div></article></body>"""
    assert wrapper.alone(page) == "T\nRelated work\nHow we search\nOn policy\nFormula x in a figure and what stands for it"


def test_constant_text_inside_articles_is_template(spark):
    """A notice that all pages of the host carry goes, with landmarks and without; headings and what varies stay."""
    for name, (before, after) in enumerate((("<article>", "</article>"), ("<div class=x>", "</div>"))):
        rows = [(i, f"https://news{name}.example/{i}", f"<body>{before}<h1>Story {i}</h1><p>Words {i * 3} of it</p><h2>More</h2><p>and {i * 7} more</p><p>Written by our newsroom. All rights reserved.</p>{after}</body>") for i in range(8)]
        out = texts(spark, rows)
        for i in range(8):
            assert out[i].replace("\nMore\n", "\n") == f"Story {i}\nWords {i * 3} of it\nand {i * 7} more"
            assert ("\nMore\n" in out[i]) == (before == "<article>")


def test_copies_tell_nothing_about_template(spark):
    body = "".join(f"<p>Paragraph {j} of a text that many pages copy</p>" for j in range(20))
    rows = [(i, f"https://copies.example/{i}", f"<body><article><h1>Copy</h1>{body}<p>Edition {i}</p></article></body>") for i in range(9)]
    out = texts(spark, rows)
    assert all(out[i].count("\n") == 21 and out[i].endswith(f"Edition {i}") for i in range(9))


def test_named_parts_inside_articles_go_if_the_template_has_them(spark):
    page = lambda i, cls: f'<body><article><h1>Story {i}</h1><p>Words of story {i}</p><div class="{cls}"><p>Other story {i + 5}</p></div></article></body>'
    out = texts(spark, [(i, f"https://blog.example/{i}", page(i, "related-posts")) for i in range(6)] + [(9, "https://one.example/", page(9, "related-posts"))])
    assert all(out[i] == f"Story {i}\nWords of story {i}" for i in range(6)) and out[9].endswith("Other story 14")


def test_kinds_of_pages_of_a_host_are_aligned_apart(spark):
    item = lambda i: f"<body><div class=top>Site</div><article><h1>Item {i}</h1><p>Text {i}</p></article></body>"
    listing = lambda i: "<body><div class=top>Site</div>" + "".join(f"<article><h2>Teaser {i} {j}</h2></article>" for j in range(4)) + "</body>"
    out = texts(spark, [(i, f"https://mixed.example/{i}", item(i) if i % 2 else listing(i)) for i in range(12)])
    for i in range(12):
        assert out[i] == (f"Item {i}\nText {i}" if i % 2 else "\n".join(f"Teaser {i} {j}" for j in range(4)))


def test_pages_without_a_host_stand_alone(spark):
    rows = [(i, None if i % 2 else "no host here", f"<div><p>Same words</p><p>Page {i}</p></div>") for i in range(8)]
    assert texts(spark, rows) == {i: f"Same words\nPage {i}" for i in range(8)}


def test_wide_pages_take_time_in_proportion_to_their_width():
    def page(n, step):
        rows = (f"<tr><td>{i}</td>{'<td><b>x</b></td>' * ((i * 7919 + step) % 13)}<td class=c{i * step % n}>u</td></tr>" for i in range(n))
        return f"<body><article><table>{''.join(rows)}</table></article></body>"

    began = time.time()
    mine, ref, match = wrapper.Aligner()(page(50_000, 3), page(50_000, 5))
    assert len(match) > 50_000 and wrapper.content(mine, match, match[2]).count("\n") >= 50_000
    assert time.time() - began < 60
    short = wrapper.Matcher()
    a, b = wrapper.Page(page(120, 3)), wrapper.Page(page(120, 5))
    short.shape(a), short.shape(b)
    whole, cells = len(short.match(a, b)), wrapper.CELLS
    try:
        wrapper.CELLS = 200
        cut = wrapper.Matcher()
        cut.shape(a), cut.shape(b)
        assert 0.2 * whole < len(cut.match(a, b)) <= whole
    finally:
        wrapper.CELLS = cells
