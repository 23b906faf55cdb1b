"""Blocks of web pages: golden pages for lists, quotes, preformatted text, tables, hidden elements and links."""

import time

import pytest

from quireworks.operators import texts as X
from quireworks.operators.markup import page_blocks


def short(html):
    return [(b["kind"], b["level"], b["marker"], b["indent"], b["text"]) for b in page_blocks(html)]


P = lambda text, indent=0: ("PARAGRAPH", 0, "", indent, text)


@pytest.mark.parametrize(("html", "want"), [
    ('<p title="the hidden cost">kept?</p><p>b</p>', [P("kept?"), P("b")]),
    ('<div aria-label="a hidden place"><p>x</p></div>', [P("x")]),
    ('<div data-hidden="false">y</div><div class=hidden>z</div>', [P("y"), P("z")]),
    ("<div hidden>" + "<div>" * 50 + "deep" + "</div>" * 50 + "more</div>b", [P("b")]),
    ("<p HIDDEN>a<p>b", [P("b")]), ("<p hidden=until-found>a</p>b", [P("b")]), ('<p style="color:red;DISPLAY : none">a</p>b', [P("b")]),
    ("<ul><li hidden>a<ul><li>b</ul><li>c</ul>", [("LIST_ITEM", 0, "•", 0, "c")]),
    ("<section><p hidden>a</section>b", [P("b")]),
    ('<ol start=3 type=i><li>x<li value=9>y<ul><li>z<p>w</ul>v</ol>u', [("LIST_ITEM", 0, "iii.", 0, "x"), ("LIST_ITEM", 0, "ix.", 0, "y"), ("LIST_ITEM", 1, "◦", 0, "z"), ("LIST_ITEM", 1, "", 0, "w"), ("LIST_ITEM", 0, "", 0, "v"), P("u")]),
    ("<ol type=A start=27><li>a<li>b</ol>", [("LIST_ITEM", 0, "AA.", 0, "a"), ("LIST_ITEM", 0, "AB.", 0, "b")]),
    ("<ul>" * 12 + "<li>x", [("LIST_ITEM", 8, "▪", 0, "x")]),
    ("<blockquote>" * 9 + "q" + "</blockquote>" * 8 + "r", [P("q", 6), P("r", 1)]),
    ("<pre> a\r\n  b &lt;</pre>t  u", [P(" a\n  b <"), P("t u")]),
    ("a <br>  b<br>c", [P("a\nb\nc")]), ("<h2>a<b>b</b> c</h2>d", [("HEADING", 2, "", 0, "ab c"), P("d")]),
    ('<script>if(a<b)"</p>"</script>d<p title="unbalanced>foo</p>e', [P("dfoo"), P("e")]),
    ("<p>a<hr><img src=x alt=' pic '><img>b", [P("a"), ("DIVIDER", 0, "", 0, ""), ("IMAGE", 0, "", 0, "pic"), P("b")]),
    ("x</div>y<!-- c --><style>p{}</style>&amp;&nbsp;&unknown;", [P("x"), P("y& &unknown;")]), ("", []), ("  \n", []), ("<title>t</title>", []),
])
def test_golden_pages(html, want):
    assert short(html) == want


def test_tables_on_their_grid():
    found = page_blocks("<table><caption>cap</caption><tr><th colspan=2>h<td rowspan=2>x &amp; y<tr><td>a<p>b</p><td><table><tr><td>in<td>ner</table>c</table>z")
    assert [(b["kind"], b["text"]) for b in found] == [("PARAGRAPH", "cap"), ("TABLE", "h x & y\na\nb in ner c"), ("PARAGRAPH", "z")]
    assert [tuple(c.values()) for c in found[1]["cells"]] == [(0, 0, 2, 1, "h"), (0, 2, 1, 2, "x & y"), (1, 0, 1, 1, "a\nb"), (1, 1, 1, 1, "in ner c")]


def test_links_cover_their_text():
    found = page_blocks("<p>  see <a href='https://x.org/?a&amp;b'>the <b>docs</b><p>here</a> now")
    assert [(b["text"], [tuple(x.values()) for x in b["links"]]) for b in found] == [("see the docs", [(4, 12, "https://x.org/?a&b")]), ("here now", [(0, 4, "https://x.org/?a&b")])]


def test_rows_of_pages(spark):
    page = "<p>find</p><table><tr><td>fi<td>nd<tr><td>find me<td>a find</table><p><a href='http://find.me'>go</a> <a href='/find'>in</a></p><hr>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.text for r in X.blocks_to_text(X.html_blocks(pages)).collect()] == ["find\nfi nd find me a find\ngo in"]
    assert [(r.block_no, r.hit_no) for r in X.block_find(X.html_blocks(pages), "find").orderBy("block_no", "hit_no").collect()] == [(0, 1), (1, 1), (1, 2), (2, 1)]
    assert [(r.anchor, r.text) for r in X.speakable_blocks(pages).orderBy("unit_no").collect()] == [(0, "find"), (1, "fi nd find me a find"), (2, "go in")]


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "a", "<div hidden>" + "<b>x" * 50_000, "<p hidden>" + "<div>x" * 50_000, "<ul>" + "<li>x<b>" * 30_000, "<table>" + "<tr><td>x" * 30_000, "<a href=" * 30_000])
def test_one_pass_over_hostile_pages(html):
    began = time.perf_counter()
    page_blocks(html)
    assert time.perf_counter() - began < 10
