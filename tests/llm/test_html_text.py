import html
import re

from tideline.llm import html_text
from tideline.llm.common import table


def text_of(page):
    return " ".join(t for k, t in html_text.blocks(page) if k == 0)


def test_blocks_of_an_article():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no";</script></head>
    <body class="home"><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><!-- ad <p>no</p> --><div class="ad big">Buy</div>
    <article class="post-body"><header><h1>Ti&#116;le&nbsp;&amp;</h1></header><p>One <b>two</b>thr<i>ee</i><br>four
    five<p>six &lt;b&gt; 3 < 4 &copy<div id='comments'><p>reader</div><aside>side</aside><form>f<button>Go</button></form>
    <table><tr><td>c1<td>c2</table><div class=cookie-notice>Accept</div><ul><li>i1<li>i2</ul>end</article>
    <div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Title & One twothree four five six <b> 3 < 4 © c1 c2 i1 i2 end"


def test_broken_pages():
    assert text_of("<article><p>a<div class='ad'>b</article>c") == "a"
    assert text_of("<article>a</b></div><p>b</nosuch>c<p") == "a b c"
    assert text_of("<main role=main>x<script>y") == "x"
    assert text_of("</article><article>x</article><article>y</article>") == "x y"
    assert html_text.blocks("") == [] and html_text.blocks("<<>") == [(1, "<<>")]
    assert html_text.blocks("plain &amp; text") == [(1, "plain & text")]
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert html_text.blocks(deep) == [(1, "x")]


def test_layout_words_around_an_article():
    assert text_of('<body class="has-sidebar menu"><div class="page with-sidebar"><article>x</article><div>y</div></div></body>') == "x"
    assert text_of('<div id="comments"><article>no</article></div><article class="comment">no</article><main class="navbar-offset">yes<div class="share">no</div></main>') == "yes"
    assert html_text.blocks('<div class="sidebar">a</div><div>b</div>') == [(2, "a"), (1, "b")]


def test_articles_of_the_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"</?p>|<br>|</?h1>", inner)]
        want[r.page_id] = (r.url, " ".join(p for p in parts if p))
    got = {r.page_id: (r.url, r.text) for r in html_text.report(pages).collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in html_text.report(pages).collect())


def test_suffix_array_on_open_pages(spark):
    shared = "home news sport about us contact imprint and more"
    rows = [(k, f"http://h.example/{k}", f"<div>{shared} page</div><div>story number {k} tells of {'abcdefgh'[k]} thing {k * 7} alone today</div><div>{shared}</div>") for k in range(6)]
    rows += [(10, "http://other.example/1", f"<div>{shared}</div>"), (11, None, None), (12, "nohost", ""), (13, "http://h.example/13", "<p>short</p>"), (0, rows[0][1], rows[0][2])]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = sorted(((r.page_id, r.text) for r in html_text.extract(given).collect()), key=str)
    want = [(k, f"page story number {k} tells of {'abcdefgh'[k]} thing {k * 7} alone today") for k in range(6)]
    # the token after the shared run is covered too where it follows it everywhere
    want = [(k, t.removeprefix("page ")) for k, t in want] + [(0, want[0][1].removeprefix("page ")), (10, shared), (11, ""), (12, ""), (13, "short")]
    assert got == sorted(want, key=str)
    assert html_text.extract(given.limit(0)).count() == 0


def test_host_of(spark):
    urls = ["https://A.example:80/x", "//b.example?q", "http://u:p@c.example#f", "nohost", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(html_text.host_of(df.url)).collect()] == ["a.example", "b.example", "c.example", "nohost", None]
