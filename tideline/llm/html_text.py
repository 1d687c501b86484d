"""HTML main text: page structure tells what may be text, a host suffix array finds what its pages repeat.

1. A page is cut into blocks (text between block-level tags). A block is *main* (inside an article or
   main element), *chrome* (inside navigation, headers, footers, asides, forms, scripts, or container
   elements whose class, id or role names such a thing) or *open* (neither). A paragraph, heading or
   quotation with such a class is open, and so are list items, table cells and widgets of an article: the
   word is evidence, and the array decides. The only article of a page is main whatever its class or
   that of an element around it; several such articles, as teasers and comments are, are chrome.
2. A page's chrome and open blocks, joined, are its token stream; the streams of a host's pages make its
   suffix array. Suffixes are sorted by host and first ``min_tokens`` tokens in range partitions; runs of
   neighbours with that prefix in common are repeats, ``min_tokens`` long, and longer ones are repeats at
   consecutive places of a page, so sorting deeper would cover no other token. A run counts where it is
   on at least ``LEAST_PAGES`` pages and ``SHARE`` of the host's pages; pages of a host with the same main
   and open blocks are copies and count as one. Pages are part of the sort order, so a run of any size,
   or a host with a third of all pages, spans as many tasks as it fills; its parts are added up after. A
   block shorter than ``min_tokens`` is also compared whole. What a repeat covers of an open block is cut
   if it is the whole block or ``min_tokens`` long, wherever the repeat began; unique runs stay.
3. The text of a page is its main blocks and what is left of its open blocks, in page order. Chrome is
   evidence for the array and never text.

Main blocks are not tested for repeats: what several articles of a host share is article all the same.

Cases: a null or empty html has empty text; a null url is a host of its own name; rows that repeat a
page are rows of their own and count as one page; unclosed and stray tags are tolerated, an element
ends with its parent; a tag that the page's end cuts off is dropped; pages of any length are read in
time linear in their length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch

# a whole tag whose quoted values hold no angle bracket; other tags, names alone; comments; the rest of markup
_TAG = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]|=\s*\"[^\"<>]*\"|=\s*'[^'<>]*'|=)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S
)
_QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLE_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?main\b", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark output picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Boxes within a line whose content is no text: what is before and after them stays one block.
_BOXES = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("svg", "math", "button")}
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea title head select option button".split())
_CHROME = frozenset("nav footer aside form menu dialog".split()) | _RAW
_MAIN = frozenset(("article", "main"))
# Elements of running text: a telling class is evidence there, and decides on others.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption".split()) | _INLINE - {"ins"}
# Parts of lists and tables, and words that articles use for parts of themselves: evidence too, inside an article.
_ITEMS = frozenset("li td th tr caption figure".split())
_VAGUE = frozenset("banner modal search widget".split())
# Class, id and role words. An article inside an element with a layout word is an article all the
# same ("page with-sidebar"); inside comments or adverts it isn't.
_AD = re.compile(r"^(?:ads?|advert\w*|adsbygoogle|sponsor\w*|cookies?|consent|gdpr|newsletter|popup)$")
_BESIDE_AD = re.compile(r"^(?:\d+|area|banner|big|block|bottom|box|container|google|inline|label|leaderboard|left|rectangle|right|side|sidebar|slot|small|space|text|top|unit|wrap|wrapper)$")
_NEVER_TEXT = re.compile(r"^(?:comments?|disqus|notice|promo|related|replies|responses|subscribe)$")
_LAYOUT = re.compile(r"^(?:banner|breadcrumbs?|complementary|contentinfo|footer|masthead|menu|menubar|modal|nav|navbar|navigation|search|share|sharing|sidebar|social|toolbar|widget)$")
_IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")}


MAIN, OPEN, CHROME, LAYOUT = 0, 1, 2, 3
#: Chrome for a class, id or role alone, and an article inside such an element or with such a name itself:
#: text where the page has no other article, as class words alone can't take a page's only one.
NAMED, UNDER = 4, 5
#: What a host repeats is on so many of its pages and on this share of them.
LEAST_PAGES, SHARE = 3, 0.1
_SUFFIX = "host string, page long, stream long, place int, length int, prefix string"


def _names_advert(name: str) -> bool:
    """Whether a class or id names an advert or a consent notice; "ad-hoc" doesn't, "ad-slot" does."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    others = [x for x in parts if not _AD.match(x)]
    return len(others) < len(parts) and (not others or all(_BESIDE_AD.match(x) for x in others) or not any(x in ("ad", "ads") for x in parts))


def _kind_inside(name: str, attributes: str, kind: int) -> int:
    """The kind of what an element holds, from its name, its attributes and the kind around it."""
    if kind == CHROME or name in ("html", "body"):
        return kind
    if name in _CHROME or name == "header" and kind not in (MAIN, UNDER):
        return CHROME
    if kind == NAMED:
        return UNDER if name in _MAIN else kind
    if "=" not in attributes:
        return MAIN if name in _MAIN and kind != UNDER else kind
    names = " ".join("".join(found).lower() for found in _NAMES.findall(attributes)).split()
    words = {w for n in names for w in re.split(r"[_-]+", n)}
    named = UNDER if name in _MAIN and kind != MAIN else NAMED
    if any(_names_advert(n) for n in names):
        return named
    if any(_NEVER_TEXT.match(w) for w in words):
        return named if name not in _PROSE else OPEN if kind not in (LAYOUT, UNDER) else kind
    if kind == UNDER:
        return kind
    if name in _MAIN or "main" in words and _ROLE_MAIN.search(attributes):
        return MAIN
    if layout := {w for w in words if _LAYOUT.match(w)}:
        if name in _PROSE or kind == MAIN and (name in _ITEMS or layout <= _VAGUE):
            return OPEN if kind != LAYOUT else kind
        return LAYOUT
    return kind


class _Tags:
    """Where tags end in one page, whatever their quotes; each look at the page goes forward only."""

    def __init__(self, page: str):
        self.page, self.quotes = page, {'"': True, "'": True}

    def end(self, at: int) -> int:
        """The index of the > that ends a tag whose name ends at ``at``; -1 if the page ends first."""
        begin = at
        while m := _QUOTE_OR_END.search(self.page, at):
            if not m[1]:
                return m.start()
            close = self.page.find(m[1], m.end()) if self.quotes[m[1]] else -1
            self.quotes[m[1]] = close >= 0  # none from here on, so none later
            at = close + 1 if close >= 0 else m.end()
        if any(self.quotes.values()):  # quotes that hide every end are not quotes, here and later
            self.quotes = dict.fromkeys(self.quotes, False)
            return self.page.find(">", begin)
        return -1


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block in page order; kind MAIN, OPEN or CHROME."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[list] = []  # [element, the kind around it, inline elements of its name inside it]; inline ones only where they change the kind
    is_open: dict[str, int] = {}
    kind, at, under, tags = OPEN, 0, 0, _Tags(page)

    def end_block():
        if text:
            whole = "".join(text)
            text.clear()
            if "&" in whole:
                whole = html_lib.unescape(whole)
            whole = _SPACE.sub(" ", whole).strip()
            if whole:
                out.append((kind if kind in (MAIN, OPEN, UNDER) else CHROME, whole))

    def leave():
        nonlocal kind
        name, outer, _ = stack.pop()
        is_open[name] -= 1
        if outer != kind:
            end_block()
            kind = outer
        return name

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m[1], m[2], m[3]
        if m[5]:  # a tag that needs a closer look
            closing, name, end = m[4], m[5], tags.end(at)
            if end < 0:
                break
            attributes, at = page[at:end], end + 1
        if not name:
            continue
        name = name.lower()
        if name in _BOXES and not closing and not attributes.endswith("/") and (ends := _BOXES[name].search(page, at)):
            at = ends.end()
            continue
        if name in _INLINE:
            top = stack[-1] if stack and stack[-1][0] == name else None
            if closing and top:
                top[2] -= 1
                if top[2] < 0:
                    leave()
            elif not closing and name not in _VOID:
                inner = _kind_inside(name, attributes, kind)
                if inner != kind:
                    end_block()
                    stack.append([name, kind, 0])
                    is_open[name] = is_open.get(name, 0) + 1
                    kind = inner
                elif top:
                    top[2] += 1
            continue
        end_block()
        if closing:
            while is_open.get(name) and leave() != name:
                pass
            continue
        for ended in (_IMPLIED_END[name],) if name in _IMPLIED_END else ():
            while stack and any(e[0] in ended for e in stack[-4:]) and stack[-1][0] in ended | _INLINE:
                leave()
        if name in _VOID or attributes.endswith("/"):
            continue
        inner = _kind_inside(name, attributes, kind)
        under += inner == UNDER and name in _MAIN
        stack.append([name, kind, 0])
        is_open[name] = is_open.get(name, 0) + 1
        kind = inner
        if name in _RAW_END:
            ends = _RAW_END[name].search(page, at)
            if not ends:
                break
            at = ends.start()
    end_block()
    only = under == 1 and all(k != MAIN for k, _ in out)
    return [(k if k != UNDER else MAIN if only else CHROME, t) for k, t in out]


def host_of(url):
    """The host part of a url, lower-cased; other strings are their own host."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host == "", F.lower(url)).otherwise(host)


def _parse(batches):
    """Every row with its blocks. page: a hash of main and open blocks, the same for copies; stream: of what the array reads."""
    from xxhash import xxh3_64_intdigest

    def hashes(pages):
        return pa.array(np.array([xxh3_64_intdigest("\0".join(x).encode("utf-8", "surrogatepass")) for x in pages], np.uint64).astype(np.int64))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [blocks(page.as_py() or "") for page in part.column("html")]
            page = hashes([t for k, t in one if k != CHROME] for one in found)
            stream = hashes([f"{k}{t}" for k, t in one if k != MAIN] for one in found)
            kinds = pa.array([[k for k, _ in one] for one in found], pa.list_(pa.int32()))
            texts = pa.array([[t for _, t in one] for one in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), page, stream, kinds, texts], names=["page_id", "url", "page", "stream", "kinds", "texts"])


def _short(token: str) -> str:
    """A token as it is compared: long ones by their 128-bit hash, so that a suffix's prefix has bounded size."""
    from xxhash import xxh3_128_hexdigest

    return token if len(token) <= 32 else "\n" + xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass"))


def places(kinds: list[int], texts: list[str], min_tokens: int, open_only: bool):
    """(place, length, prefix) of a page's suffixes: its blocks other than main ones are one token stream.

    A suffix's prefix is its first ``min_tokens`` tokens, whatever blocks they are in; suffixes with
    fewer have none. A block of fewer tokens is also compared whole, marked as such.
    """
    tokens, opened = [], [0]
    for kind, text in zip(kinds, texts):
        if kind == MAIN:
            continue
        words = [_short(t) for t in text.split(" ")]
        if len(words) < min_tokens and (kind == OPEN or not open_only):
            yield len(tokens), len(words), "\n\n" + " ".join(words)
        tokens += words
        opened += [opened[-1] + (kind == OPEN) * (i + 1) for i in range(len(words))]
    for k in range(len(tokens) - min_tokens + 1):
        if not open_only or opened[k + min_tokens] > opened[k]:
            yield k, min_tokens, " ".join(tokens[k : k + min_tokens])


def _suffixes(min_tokens: int, open_only: bool, most: int = 1 << 15):
    """One row for each suffix of a page's stream."""

    def run(batches):
        for batch in batches:
            rows, found = [], []

            def made():
                take = pa.array(rows, pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), (pa.int32(), pa.int32(), pa.string()))]
                return pa.RecordBatch.from_arrays([batch.column(n).take(take) for n in ("host", "page", "stream")] + columns, names=["host", "page", "stream", "place", "length", "prefix"])

            for i, (kinds, texts) in enumerate(zip(batch.column("kinds"), batch.column("texts"))):
                for one in places(kinds.as_py(), texts.as_py(), min_tokens, open_only):
                    rows.append(i)
                    found.append(one)
                    if len(rows) == most:
                        yield made()
                        rows, found = [], []
            yield made()

    return run


def _runs(batches):
    """Runs of a sorted part of the array whose suffixes share their prefix, with the pages they are on.

    Runs of fewer than LEAST_PAGES pages stay behind, but for a part's first and last, which may go on in others.
    """
    names = ["host", "prefix", "first", "last", "n"]
    last, is_first = None, True

    def made(runs):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        host, prefix, page = batch.column("host"), batch.column("prefix"), batch.column("page").to_numpy()
        differs = pc.or_(pc.not_equal(host.slice(1), host.slice(0, len(host) - 1)), pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)))
        starts = np.r_[True, differs.to_numpy(zero_copy_only=False)]
        news = starts.copy()
        news[1:] |= page[1:] != page[:-1]
        at = np.flatnonzero(starts)
        n, ends = np.add.reduceat(news.astype(np.int64), at), np.r_[at[1:], len(page)] - 1
        out = []
        for j in sorted({0, len(at) - 1} | set(np.flatnonzero(n >= LEAST_PAGES).tolist())):
            run = [host[at[j]].as_py(), prefix[at[j]].as_py(), int(page[at[j]]), int(page[ends[j]]), int(n[j])]
            if j == 0 and last and last[:2] == run[:2]:
                run = [*run[:2], last[2], run[3], last[4] + run[4] - (last[3] == run[2])]
            elif j == 0 and last:
                out += [last] if is_first or last[4] >= LEAST_PAGES else []
                is_first = False
            if j == len(at) - 1:
                last = run
            else:
                out += [run] if is_first or run[4] >= LEAST_PAGES else []
                is_first = False
        if out:
            yield made(out)
    if last:
        yield made([last])


def repeated_prefixes(stream: DataFrame, min_tokens: int) -> DataFrame:
    """(host, prefix) of what enough of a host's pages hold, from stream(host, page, stream, kinds, texts), one row a stream."""
    pages = stream.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    suffix = stream.mapInArrow(_suffixes(min_tokens, False), _SUFFIX).select("host", "prefix", "page", "stream")
    order = ["host", "prefix", "page", "stream"]
    run = suffix.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "host string, prefix string, first long, last long, n long")
    # parts of a run, in order: a page that one ends with and the next begins with is one page
    before = F.lag("last").over(Window.partitionBy("host", "prefix").orderBy("first", "last"))
    whole = run.withColumn("n", F.col("n") - F.coalesce((before == F.col("first")).cast("long"), F.lit(0))).groupBy("host", "prefix").agg(F.sum("n").alias("n"))
    return whole.where(F.col("n") >= LEAST_PAGES).join(pages, "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "prefix")


def left_of(kinds: list[int], texts: list[str], covered: list[tuple[int, int]], min_tokens: int) -> str:
    """A page's text without the repeats in its open blocks, given as (place, length) in its stream.

    What a repeat covers of a block goes where it is the whole block or ``min_tokens`` long: the first word
    of a story isn't cut because other stories begin alike below the same menu.
    """
    sizes = [0 if k == MAIN else t.count(" ") + 1 for k, t in zip(kinds, texts)]
    depth = np.zeros(sum(sizes) + 1, np.int64)
    for place, length in covered:
        depth[place] += 1
        depth[place + length] -= 1
    is_covered, at, out = np.cumsum(depth[:-1]) > 0, 0, []
    for kind, text, size in zip(kinds, texts, sizes):
        inside = is_covered[at : at + size]
        at += size
        if kind == CHROME:
            continue
        if kind == OPEN and inside.any():
            borders = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
            gone = np.zeros(size, bool)
            for begin, end in zip(borders[::2], borders[1::2]):
                gone[begin:end] = end - begin >= min(min_tokens, size)
            tokens = text.split(" ")
            text = " ".join(tokens[i] for i in np.flatnonzero(~gone))
        if text:
            out.append(text)
    return " ".join(out)


def _texts(min_tokens: int):
    def run(batches):
        for batch in batches:
            texts = []
            for kinds, found, covered in zip(batch.column("kinds"), batch.column("texts"), batch.column("covered")):
                covered = [(c["place"], c["length"]) for c in covered.as_py() or []]
                texts.append(left_of(kinds.as_py(), found.as_py(), covered, min_tokens))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, min_tokens: int = 8) -> DataFrame:
    """(page_id, url, text), one row per row of ``pages(page_id, url, html)``."""
    scratch = Scratch(pages.sparkSession)
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    id_type = dict(given.dtypes)["page_id"]
    parsed = given.mapInArrow(_parse, f"page_id {id_type}, url string, page long, stream long, kinds array<int>, texts array<string>")
    parsed = parsed.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    parsed = scratch.saved(parsed, "blocks", "zstd")

    has_open = F.array_contains("kinds", OPEN)
    key = ["host", "page", "stream"]
    # main blocks stay behind; copies of a page are one row of the array
    tested = F.filter(F.arrays_zip("kinds", "texts"), lambda b: b["kinds"] != MAIN)
    stream = parsed.select(*key, tested.alias("b")).where(F.size("b") > 0).select(*key, F.col("b.kinds").alias("kinds"), F.col("b.texts").alias("texts")).dropDuplicates(key)
    known = scratch.saved(repeated_prefixes(stream, min_tokens), "repeated", "zstd")
    suffix = stream.where(has_open).mapInArrow(_suffixes(min_tokens, True), _SUFFIX)
    covered = suffix.join(known, ["host", "prefix"], "left_semi").groupBy(*key).agg(F.collect_list(F.struct("place", "length")).alias("covered"))  # a page's own
    some = parsed.where(has_open).join(covered, key, "left").select("page_id", "url", "kinds", "texts", "covered").mapInArrow(_texts(min_tokens), f"page_id {id_type}, url string, text string")
    main_text = F.array_join(F.transform(F.filter(F.arrays_zip("kinds", "texts"), lambda b: b["kinds"] == MAIN), lambda b: b["texts"]), " ")
    return parsed.where(~has_open).select("page_id", "url", main_text.alias("text")).union(some)


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
