"""Main text of pages: an independent reading of the given pages, and pages made by hand."""

import html
import random
import re
import time

import pytest

from wagelens.llm import html_extract
from wagelens.llm.html_extract import Page

from ..conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string, article int, host string, r int, classes string"


def plain(page, template=frozenset(), main=None):
    return Page(page).article(set(template), main)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    want = {}
    for p in pages:  # this layout has one article of h1 and p, with b and br inside
        inner = re.search("<article>(.*?)</article>", p["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<br>|</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[p["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = html_extract.op12_html_extraction(spark, SF_SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert {r["page_id"]: r["text"] for r in rows} == want and len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


FULL = """<!doctype html><html><head><title>No title</title><style>p > a {}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="nav-open"><header><h1>Site name</h1></header><nav>Menu <a href=x>one</a></nav><div id="cookie-notice"><p>We use cookies</p></div>
<div class="content with-sidebar"><main><article class="post"><header><h1>Head&shy;line &amp; more</h1></header>
<p>First <i>part</i> of&nbsp;it,<br>second&#33;</p><div class="ad-slot"><p>Buy now</p></div>
<p title="a > b">Third &lt;tag&gt; <code>x&amp;lt;y</code></p><ul><li>item one<li>item two</ul><aside>Aside</aside>
<form><label>Mail</label><input value="x"><button>Send</button></form><table><tr><td>cell 1<td>cell 2</table>
<section id="comments"><article class="comment"><p>I disagree</p></article></section><!-- <p>hidden</p> -->
<div style="display: none">unseen</div><div class="share-buttons">Share</div><p>Last<footer>Written by</footer></article></main>
<div class="sidebar"><article><h2>Other</h2></article></div></div><footer>Copyright</footer></body></html>"""


def test_everything_but_the_article_goes():
    assert plain(FULL).split("\n\n") == [
        "Head\xadline & more", "First part of it, second!", "Third <tag> x&lt;y", "item one", "item two", "cell 1", "cell 2", "Last"]


def test_broken_markup():
    assert plain("") == "" and plain("just text &amp; more") == "just text & more" and plain("a < b <") == "a < b <"
    assert plain("<nav>menu<article><p>text</article> more") == "text"
    assert plain("<div class=ad>buy<article><p>one</div></b><p>two<b>three</article>x") == "one\n\ntwothree"
    assert plain("<article>a<script>x</article>") == "a" and plain("<article>a<!-- x</article>") == "a"
    assert plain("<body><p>one<p>two</body></html><p>three") == "one\n\ntwo\n\nthree"
    assert plain('<article><a href="x>link</a> y</article>') in ("link y",)
    assert plain("<div class='comments'>c</div><div>b</div>") == "b"


def site(rng, host, n, head=None):
    """Pages without any telling name: menu, a notice inside the text, and a footer that all pages share."""
    out = []
    for i in range(n):
        word = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
        paragraphs = [word(12) for _ in range(rng.randint(2, 6))]
        title = head or word(4)
        page = ("<html><body><div class=x1><span>Home</span><span>About us</span></div><table><tr><td class=k><h2>" + title + "</h2>"
                + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>Write to the editors</p></td></tr></table>"
                + f"<div class=x2><a href=/{i}>{word(2)}</a><div>All rights kept</div></div></body></html>")
        out.append((f"https://{host}/{i}", page, "\n\n".join([title, *paragraphs])))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_templates_of_hosts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    pages = site(rng, "A.example.org", 40) + site(rng, "b.example.org:80", 9)
    few = site(rng, "few.example.org", 2) + site(rng, "same.example.org", 1, "Same") * 8
    rows = [(i, u, h, 1, "h", 2, "c") for i, (u, h, _) in enumerate(pages + few)]
    rows += [(None, None, None, 1, "h", 2, "c"), (-1, "no url", "", 1, "h", 2, "c")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = html_extract.extract(df)
    assert sorted(found.columns) == sorted(df.columns)
    got = found.collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["article"] for r in got}
    for i, (_, _, want) in enumerate(pages):
        assert text[i] == want
    for i, (_, _, want) in enumerate(few, len(pages)):  # no template: the element path is found, the notice stays
        assert text[i] == want + "\n\nWrite to the editors"
    assert text[None] == "" and text[-1] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_shared_passages_stay(spark):
    rng = random.Random(9)
    pages = []
    for i, (u, h, want) in enumerate(site(rng, "c.example.org", 30)):
        h = h.replace("<table><tr><td class=k>", "<article>").replace("</td></tr></table>", "</article>")
        if i % 3:  # a passage of two thirds of the pages is no template
            h, want = h.replace("<p>Write", "<p>A passage of many pages</p><p>Write"), want + "\n\nA passage of many pages"
        pages.append((i, u, h, want))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r["page_id"]: r["article"] for r in html_extract.extract(df).collect()} == {p[0]: p[3] for p in pages}


def test_classes_must_be_ordered_and_nested():
    page = Page("<div>a</div><div>b</div><div>a</div><div>b</div><p>c</p>")
    a, b, c = page.texts[0].role, page.texts[1].role, page.texts[4].role
    assert page.template([[a, b], [c]]) == {a, b, c}
    assert page.template([[b, a]]) == set()
    assert page.template([[a, c]]) == set()
    crossing = Page("<p>x</p><p>a</p><p>a</p><p>y</p>")
    x, a, _, y = (t.role for t in crossing.texts)
    assert crossing.template([[x, y], [a]]) == {x, y, a}
    split = Page("<p>a</p><p>x</p><p>b</p><p>a</p><p>b</p>")
    a, x, b = (t.role for t in split.texts[:3])
    assert split.template([[x], [a, b]]) == {x}


def test_time_is_near_linear():
    for piece in ("<p>some text &amp; <b>more</b>", "<a href=\"x ", "<", "<!-", "<div class='", "<b>x", "</div>", "<p", "&amp", "<!--x"):
        spent = []
        for n in (4000, 16000):
            begin = time.perf_counter()
            plain(piece * n)
            spent.append(time.perf_counter() - begin)
        assert spent[1] < 12 * spent[0] + 0.3, piece
