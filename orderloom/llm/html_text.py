"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by weights learned from
labelled pages: for each kind of token the logarithm of how much more often it stands inside the marked
content than outside. One linear scan finds the contiguous region with the largest sum. It is widened to
the ends of an article element of which it holds half the words or more.

A block that never is content is one negative token, whatever it holds, and is left out of the region:
scripts and the like, menus, asides, forms, footers, page headers, hidden elements, and elements with such
a role, or with such a class or id as a whole (``sidebar``; of compounds the last part counts, ``site-footer``,
but not behind a word like ``has``, ``no`` or ``post``). Two things speak against that, except for scripts
and the like: a block with more than half of the page's words that holds a headline, an article or
nearly everything is the page itself; and one that is never closed ends where an article begins. Within an
article, a block named after a menu or a search stays if it holds at least ``PLAIN`` words of which most aren't
linked, and linked words count as others do: lists of links are part of what was written.

The region's text is what its blocks hold: character references decoded, white space inside a block one
space, blocks joined by a newline. Nothing else is dropped, and no length is capped.

Defined results: null, empty and contentless pages give an empty string; of equal regions the longest
of the first is taken; markup that isn't closed is read as browsers do (to the end); repeated rows are
extracted alike; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

# attributes as browsers read them: a quote opens a string only right after "="
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# Element names of HTML, by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = set("button select option input textarea script style noscript template iframe svg canvas object head title".split())
STRUCTURE = set("nav footer aside form menu dialog".split())
OUTSIDE_NAMES = set("""
nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar sidebars aside rail widget widgets
ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promoted banner
cookie cookies consent gdpr notice notices alert notification newsletter subscribe subscription signup login paywall popup modal overlay
comment comments commentlist disqus respond replies reply discussion comment-list comments-area comment-form
share sharing social related recommended recommendations trending pagination pager toolbar search searchform skip hidden copyright
social-links share-buttons skip-link related-posts ad-slot ad-container cookie-bar
""".split())
#: Names that an article's own parts may have, and the words that such a part holds at least.
SOFT = {"menu", "menus", "search"}
PLAIN = 8
#: The name of a link's tag within an article; it has a weight of its own.
INNER = "a-within"
#: First parts of compounds that name a page's or an article's own parts.
OWN_PARTS = set("has with no without is in not hide show post entry article story content main section chapter page-has".split())
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion"}


def _named(value: str) -> set[str]:
    """What a class or id says that never is content."""
    found = set()
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if token in OUTSIDE_NAMES:
            found.add(parts[0] if parts[0] in _COMMENTS else token)
        elif parts and parts[-1] in OUTSIDE_NAMES and not (len(parts) > 1 and parts[0] in OWN_PARTS):
            found.add(parts[-1])
    return found


def _outside(name: str, attributes: str, within: bool) -> tuple[bool, bool, bool]:
    """Whether an element never holds content, whether it holds readers' comments, and whether that depends on its words; ``within``: it stands inside an article."""
    out, said, own = name in STRUCTURE, set(), False
    if attributes and name not in ("html", "body", "article", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)) or (key == "role" and value in OUTSIDE_ROLES):
                out = True
            elif key in ("class", "id"):
                said |= _named(value)
                own = own or any(re.split(r"[^a-z]+", x)[0] in OWN_PARTS for x in value.split())
    if within:
        said -= {"header", "banner"}
    soft = within and not out and bool(said) and said <= SOFT
    out = out or bool(said) or (name == "header" and not within and not own)
    return out, bool(said & _COMMENTS), soft


class _Block:
    """A stretch of tokens that may be left out: [start, end), where an article starts in it, and whether it was closed."""

    def __init__(self, start: int, name: str, certain: bool, comments: bool, soft: bool):
        self.start, self.name, self.certain, self.comments, self.soft = start, name, certain, comments, soft
        self.end, self.article, self.head = -1, -1, False


def _scanned(page: str) -> tuple[list[tuple], list[_Block], list[list[int]]]:
    """All tokens (kind, name or text, words), the blocks that may be left out, and the articles, in order of their starts."""
    out: list[tuple] = []
    blocks: list[_Block] = []
    articles: list[list[int]] = []
    stack: list[tuple] = []  # (name, block, article) of open elements
    opened = Counter()
    live: list[_Block] = []  # open blocks, of which the first ``headed`` know of a headline and the first ``begun`` of an article
    headed = begun = 0
    at, link, size = 0, 0, len(page)

    def close(count: int) -> None:
        nonlocal link, headed, begun
        for _ in range(count):
            n, b, a = stack.pop()
            opened[n] -= 1
            link -= n == "a"
            if b is not None:
                b.end = len(out)
                live.pop()
            if a is not None:
                a[1] = len(out)
        headed, begun = min(headed, len(live)), min(begun, len(live))

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            text = page[at:end]
            out.append(("w" if not link else "i" if opened["article"] or opened["main"] else "a", text, len(text.split())))
        if not m:
            break
        at, name = m.end(), m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text = html.escape(m[0][9:].removesuffix("]]>"))
                out.append(("w", text, len(text.split())))
            elif m[0] in ("<!--[-->", "<!--]-->"):
                out.append(("m", m[0][4], 0))
            continue
        name, attributes = name.lower(), m[3]
        if m[1]:
            if opened[name]:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                for n, b, _ in stack[k + 1 :]:  # left open by their authors
                    if b is not None and b.article >= 0:
                        b.end = b.article
                ends = [(b, b.article) for _, b, _ in stack[k + 1 :] if b is not None and b.article >= 0]
                close(len(stack) - k - 1)
                for b, e in ends:
                    b.end = e
                out.append((">", name, 0))
                close(1)
            else:
                out.append((">", name, 0))
            continue
        if name in ("main", "h1"):
            for b in live[headed:]:
                b.head = True
            headed = len(live)
        if name in ("main", "article"):
            for b in live[begun:]:
                b.head = b.head or not b.comments
                if b.article < 0 and not b.comments and not b.certain:
                    b.article = len(out)
            begun = len(live)
        block = article = None
        if name not in VOID:
            certain = name in NEVER
            outside, comments, soft = (True, False, False) if certain else _outside(name, attributes, bool(opened["article"] or opened["main"]))
            if outside:
                block = _Block(len(out), name, certain, comments, soft)
                blocks.append(block)
            if name == "article":
                article = [len(out), -1]
                articles.append(article)
        elif name == "input":
            continue
        out.append(("<", INNER if name == "a" and (opened["article"] or opened["main"]) else name, 0))
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW and name != "a":
            if block is not None:
                block.end = len(out)
            continue
        if name == "a" and opened["a"]:  # links don't nest
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "a")
            if k == len(stack) - 1:
                close(1)
        stack.append((name, block, article))
        opened[name] += 1
        link += name == "a"
        if block is not None:
            live.append(block)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    ends = [(b, b.article) for _, b, _ in stack if b is not None and b.article >= 0]
    close(len(stack))
    for b, e in ends:
        b.end = e
    return out, blocks, articles


def tokens(page: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(kind, name or text, words): "<" and ">" for tags, "w" for text, "a" for linked text outside of articles,
    "x" for a whole block that never is content; and the places of the articles."""
    raw, blocks, articles = _scanned(page)
    before = [0, *itertools.accumulate(n for _, _, n in raw)]
    linked = [0, *itertools.accumulate(n if kind in "ai" else 0 for kind, _, n in raw)]
    words = lambda b: before[b.end] - before[b.start]
    outer, to = [], 0
    for b in blocks:
        if b.start >= to:
            outer.append(b)
            to = max(to, b.end)
    total, free = before[-1], before[-1] - sum(words(b) for b in outer)
    out, place, at = [], [0] * (len(raw) + 1), 0
    left = iter(blocks)
    b = next(left, None)
    while at < len(raw):
        while b is not None and b.start < at:
            b = next(left, None)
        place[at] = len(out)
        if b is not None and b.start == at and b.end > at:
            n = words(b)
            whole = not b.certain and 2 * n > total and (b.head or (not b.comments and 10 * free < n))
            whole = whole or (b.soft and n >= PLAIN and 2 * (linked[b.end] - linked[b.start]) < n)
            if not whole:
                out.append(("x", b.name, 1))
                for i in range(at, b.end):
                    place[i] = len(out) - 1
                at = b.end
                continue
            b = next(left, None)
        kind, text, n = raw[at]
        out.append(("w" if kind == "i" else kind, text, n))
        at += 1
    place[len(raw)] = len(out)
    return out, [(place[s], place[e]) for s, e in articles]


# --- labelled pages: content stands between the comments [ and ]

_OPEN, _CLOSE = "<!--[-->", "<!--]-->"
_CONTENT = [
    "<h1>Reed beds</h1><p>Reed beds clean the water that runs through them, slowly and without any pumps.</p><p>They need light, <b>mud</b> and time.</p>",
    '<h1>Bridge closed</h1><p>The old bridge will stay closed until spring, the town said on Monday.</p><p>Boats may pass. <a href="x">A map</a> shows the way round.</p><ul><li>Walkers take the ferry.</li><li>Cars drive by the mill.</li></ul>',
    "<h1>How to sharpen a plane</h1><p>Flatten the back first.<br>Then hone the bevel at thirty degrees, and take off the burr.</p><blockquote>Sharp tools are safe tools.</blockquote><p>Done.</p>",
    "<h2>Rainfall by month</h2><p>The station has measured rain since the year of the flood.</p><table><thead><tr><th>Month</th><th>mm</th></tr></thead><tbody><tr><td>May</td><td>61</td></tr><tr><td>June</td><td>74</td></tr><tr><td>July</td><td>80</td></tr><tr><td>August</td><td>69</td></tr></tbody></table><p>July was the <span>wettest</span> of <span class=\"n\">all</span> months.</p>",
    "<h1>Bread in one bowl</h1><ol><li>Stir flour and water.</li><li>Wait.</li><li>Fold it twice, an hour apart.</li><li>Bake it hot.</li></ol><dl><dt>Flour</dt><dd>500 g</dd><dt>Water</dt><dd>350 g</dd></dl><p>It keeps for <span>a week</span>.</p>",
    '<h1>Where names come from</h1><div><div>Many towns are called after a ford, a hill or a well, and some after all three.</div><div>The list of <a href="f">fords</a>, <a href="h">hills</a> and <a href="w">wells</a> is long.</div></div><figure><img src="m.png"><figcaption>A map of wells</figcaption></figure><h2>Fords</h2><p>A ford is where one walks through a river.</p>',
    "<h1>Release 4</h1><pre>make all\nmake check</pre><p>This release mends the <code>join</code> command, which lost a row when both sides were empty.</p><ul><li>faster</li><li>smaller</li></ul><p>Thanks to <em>all</em> who wrote to us.</p>",
    "<p>I walked to the lake this morning before anyone was awake.</p><p>Ice.</p><p>A heron stood where the boats lie in summer, and it did not mind me at all, or so it looked.</p><hr><p><span>Later</span> it <span>snowed</span> <i>hard</i>.</p>",
]
_LINKS = '<ul><li><a href="a">Shop</a></li><li><a href="b">Help</a></li><li><a href="c">Cart</a></li><li><a href="d">Home</a></li></ul>'
_BEFORE = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/w">Water</a></li></ul></nav><div class="ad">Buy seeds now</div>',
    '<header><div>The Daily Plank</div><div>Est. 1902</div></header><div id="menu"><a href="1">News</a> <a href="2">Sport</a> <a href="3">Weather</a></div>',
    _LINKS + '<table><tr><td><a href="d">Old</a></td><td><a href="e">New</a></td></tr></table>',
    '<div><a href="/">Start</a> &gt; <a href="/x">Archive</a> &gt; <a href="/y">Spring</a></div><div><span>Log in</span></div>' + _LINKS,
    '<table><tr><td><img src="logo.gif"></td><td><a href="a">One</a> | <a href="b">Two</a> | <a href="c">Three</a></td></tr></table><form><input name="q"></form>',
]
_AFTER = [
    "<footer>&copy; Reeds &middot; Imprint</footer>",
    '<div class="comments"><div>anna: first</div><div>ben: no way</div></div><div class="footer">All rights reserved</div>',
    '<form><input name="q"><button>Search</button></form><div><a href="f">Terms</a> | <a href="g">Privacy</a></div>',
    '<div><ul><li><a href="1">Ten barns</a></li><li><a href="2">Old mills</a></li><li><a href="3">More like this</a></li><li><a href="4">Next</a></li></ul></div><div><a href="t">Top</a></div>',
    '<div><span><a href="p">Print</a></span> <span><a href="s">Send</a></span> <span><a href="q">Quote</a></span></div><div>Site by <a href="m">Mill</a></div>',
]
#: Every content between every two frames, some of them in an element of their own.
LABELLED = [
    f"<html><head><title>t</title></head><body>{a}{_OPEN}{(f'<div>{c}</div>', c, f'<article>{c}</article>')[(i + j) % 3]}{_CLOSE}{b}</body></html>"
    for i, c in enumerate(_CONTENT) for j, (a, b) in enumerate(itertools.product(_BEFORE, _AFTER))
]


def fit(labelled: list[str] = LABELLED) -> dict[str, float]:
    """Weights of the token kinds: words ("w", linked "a", outside "x") and tags."""
    inside, outside = Counter(), Counter()
    for page in labelled:
        where = outside
        for kind, text, n in tokens(page)[0]:
            if kind == "m":
                where = inside if text == "[" else outside
            elif kind == "<":
                where["t" + text] += 1
            elif kind != ">":
                where[kind] += n
    odds = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in {*inside, *outside}}
    # words score positive and tags negative; a tag that stands inside more often costs next to nothing, and so does any end tag
    return {k: (max(0.02, min(v, 1.0)) if k in "wa" else min(-0.01, max(v, -4.0)) if k != "x" else -0.1) for k, v in odds.items()} | {"t": -0.1, ">": -0.05}


def region(toks: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """The tokens [from, to) with the largest sum of scores; equal sums prefer the longer region."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    unknown, end = weights["t"], weights[">"]
    for i, (kind, text, n) in enumerate(toks):
        total += weights.get("t" + text, unknown) if kind == "<" else end if kind == ">" else weights["x"] if kind == "x" else weights.get(kind, 0.0) * n
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best or (total == best and start == where[0] and total > 0):
            best, where = total, (start, i + 1)
    return where


def widened(toks: list[tuple], where: tuple[int, int], articles: list[tuple[int, int]]) -> tuple[int, int]:
    """The region with all of each article of which it holds half the words or more."""
    words = lambda a, b: sum(n for kind, _, n in toks[a:b] if kind in "wa")
    a, b = where
    for s, e in articles:
        if s < where[1] and e > where[0] and (s < a or e > b) and 2 * words(max(s, where[0]), min(e, where[1])) >= words(s, e):
            a, b = min(a, s), max(b, e)
    return a, b


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    toks, articles = tokens(page)
    a, b = region(toks, weights)
    if a == b:
        return ""
    a, b = widened(toks, (a, b), articles)
    blocks, now = [], []
    for kind, text, _ in toks[a:b]:
        if kind in "<>x":
            if text in BLOCK:
                blocks.append(now)
                now = []
            elif text == "br":
                now.append(" ")
        elif kind != "m":
            now.append(text)
    blocks.append(now)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, keep: list[str], labelled: list[str] = LABELLED) -> DataFrame:
    """The columns ``keep`` with ``_main``. A kept column of that name gets an underscore behind it."""
    weights = fit(labelled)
    kept = _store.Kept(pages, keep, ["_main"])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_html")
            names = [x for x in batch.schema.names if x != "_html"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array([extract(x, weights) for x in batch.column(at).to_pylist()], pa.string())], [*names, "_main"])

    return kept.back(kept.given(pages, F.col("html").alias("_html")).mapInArrow(run, kept.shape("_main string")), "_main")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return out.select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))
