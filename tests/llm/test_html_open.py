from tideline.llm import html_text


def test_open_blocks_beside_an_article(spark):
    """Unique text outside the article stays, in page order; what the host repeats goes."""
    shared = "home news sport about us contact imprint and more things"
    rows = [(k, f"http://h.example/{k}", f"<div>{shared}</div><h1>Heading {'abcdef'[k]}</h1><article><p>teaser {k}</p></article><div>body of story {k} in a plain element</div>") for k in range(6)]
    rows += [(9, "http://h.example/9", "<nav>menu</nav><article>only this</article>"), (10, "http://h.example/10", "<nav>menu</nav>"), (11, "http://h.example/11", None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"Heading {'abcdef'[k]} teaser {k} body of story {k} in a plain element" for k in range(6)}
    assert got == want | {9: "only this", 10: "", 11: ""}


def test_phrases_and_copies_stay(spark):
    """Two pages that share a phrase, a heading or everything lose nothing; long repeats of a host go."""
    menu = "home news sport about us contact imprint and more things"
    story = "<div>one whole article that stands at two addresses of the host with all its words</div><p>By Ann</p>"
    phrase = "at the end of the day it is"
    rows = [(k, f"http://h.example/{k}", f"<div>{menu}</div><p>Part {k}</p><p>tale {'abcdefghijkl'[k]} says {phrase if k < 2 else k} done{k}</p>") for k in range(10)]
    rows += [(20, "http://h.example/20", story), (21, "http://h.example/21", story), (22, "http://c.example/1", story), (23, "http://c.example/2", story)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "one whole article that stands at two addresses of the host with all its words By Ann"
    want = {k: f"Part {k} tale {'abcdefghijkl'[k]} says {phrase if k < 2 else k} done{k}" for k in range(10)}
    assert got == want | {k: whole for k in (20, 21, 22, 23)}


def test_class_words_never_take_the_only_article(spark):
    kept = {
        "<div class='related-content'><article><p>body</p></article></div>": "body",
        "<div id='promo-wrapper'><article>whole body</article></div>": "whole body",
        "<article class='related'>the only</article>": "the only",
        "<div class='ad-slot'><article>only <div class='comments'>c</div>it</article></div>": "only it",
        "<article>x<ul><li class='social'>Social life of bees</li></ul><table><tr><td class='share'>12</td></tr></table><div class='widget'>Widget story text</div></article>": "x Social life of bees 12 Widget story text",
        "<article>main</article><div class='related'><article>teaser</article></div>": "main",
        "<div class='related'><article>one</article><article>two</article></div><div>text</div>": "text",
        "<nav><article>no</article></nav>": "",
        "<article>a</article><section class='responses'>r</section><div class='replies'><p>r</p></div>": "a",
        "<article>foo<img>bar foo<svg><text>no</text></svg>bar <ruby>x<rp>(</rp></ruby>z, <acronym>A</acronym>b<input>c<picture><img></picture>d <button>b</button>e</article>": "foobar foobar x(z, Abcd e",
    }
    rows = [(k, f"http://h{k}.example/", page) for k, page in enumerate(kept)] + [(100, None, "<article>text</article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(kept))] == list(kept.values()) and got[100] == "text"


def test_repeats_at_the_limits(spark):
    """What exactly LEAST_PAGES pages and exactly SHARE of a host's pages hold goes; a page less, and it stays."""
    line = "one two three four five six seven eight nine"
    page = lambda k, n: f"<div>{line if k < n else ''}</div><div>own words number {k} of this page alone and no other {k * k}</div>"
    for pages, n, gone in ((30, 3, True), (30, 2, False), (31, 3, False), (40, 4, True)):
        rows = [(k, f"http://h.example/{k}", page(k, n)) for k in range(pages)]
        got = [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
        assert any(line in t for t in got) != gone
