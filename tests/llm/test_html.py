"""HTML extraction: awkward markup, whole articles, and precision and recall on pages that the weights weren't learned from."""

from __future__ import annotations

import collections
import itertools
import random
import time

import pytest

from orderloom.llm import html_text

WEIGHTS = html_text.fit()
LONG = "Words of the article go on and on for a while here, as they do."
CELLS = "".join("<tr>" + "".join(f"<td>{6 * i + j}</td>" for j in range(6)) + "</tr>" for i in range(10))
LINKS = "; ".join(f"<a href={i}>Name of {i}</a>" for i in range(20))
NAMES = "; ".join(f"Name of {i}" for i in range(20))
NUMBERS = "\n".join(map(str, range(60)))
PAGES = [
    (None, ""), ("", ""), ("<p>hello", "hello"), ("plain  words\nonly", "plain words only"), ("<br><hr><img src=x>", ""), ("<a href=x>", ""), ("a < b and <", "a < b and <"),
    ('<div class="ad">x<article><p>Main text goes on here</p></article>', "Main text goes on here"),
    ("<nav><a>m</a></nav><main><header><h1>T</h1></header><p>A &lt;b&gt; c&nbsp;d &amp;amp; e</p><aside>no</aside><section id='comments'><article><p>bad comment</p></article></section></main><footer>f</footer>", "T\nA <b> c d &amp; e"),
    ("<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Site name</header><div class='cookie-notice'>We use cookies</div><article><h1>Title</h1><p>One<br>two <b>th</b>ree</p><form>Mail <input></form><p>last.</p></article><footer>Imprint</footer></body></html>", "Title\nOne two three\nlast."),
    # wrappers named after what they hold beside the content
    (f'<div class="page with-sidebar"><div>{LONG}</div><div class="sidebar">Side</div></div>', LONG), (f'<body class="has-sidebar no-ads"><p>{LONG}</p></body>', LONG),
    # a stray quote opens no string
    (f'<article><p class=x">{LONG}</p><p "y>Two.</p><p z=\'>Three.</p></article><p title=\'>', LONG + "\nTwo."), (f'<article><p class="a"b>{LONG}</p><p data-x=1 y = "2>3">Two.</p></article>', LONG + "\nTwo."),
    # parts of the article with names like those of a page
    (f'<div class="post-header"><h1>Head line</h1></div><div class="body"><p>{LONG}</p></div>', "Head line\n" + LONG), (f'<article><p>{LONG}</p><div class="social-history"><p>Old days.</p></div></article>', LONG + "\nOld days."),
    (f'<header class="entry-header"><h1>Head line</h1></header><p>{LONG}</p>', "Head line\n" + LONG),
    (f"<body><div><p>{LONG}</p><table>{CELLS}</table><p>Last.</p></div></body>", f"{LONG}\n{NUMBERS}\nLast."), (f"<article><p>{LONG}</p><p><a href=1>One</a> <a href=2>Two</a></p></article>", LONG + "\nOne Two"),
    # a form around the page; comments longer than the article; an aside with articles
    (f"<form id=f><div class=nav><a href=1>Home</a></div><h1>T</h1><p>{LONG}</p><input></form>", "T\n" + LONG), (f"<h1>T</h1><p>{LONG}</p><div class=comments>" + f"<p>x {LONG}</p>" * 5 + "</div>", "T\n" + LONG),
    (f"<article><p>{LONG}</p></article><aside><article>Teaser</article></aside>", LONG), (f"<article><p>One<div class=ad>x</div>two {LONG}</p></article>", f"One\ntwo {LONG}"),
    # lists of links and parts called menu that belong to the article; a menu of links doesn't, nor does a search box
    (f"<article><h1>List</h1><p>{LINKS}</p><p>Done now.</p></article>", f"List\n{NAMES}\nDone now."),
    (f"<article><h1>List</h1><ul>{''.join(f'<li>{x}</li>' for x in LINKS.split('; '))}</ul><p>{LONG}</p></article>", "List\n" + NAMES.replace("; ", "\n") + "\n" + LONG),
    (f"<nav>{LINKS}</nav><article><p>{LONG}</p><section class=menu><p>Soup of the day with bread</p><p>Fish with <a href=p>new potatoes</a></p></section></article>", LONG + "\nSoup of the day with bread\nFish with new potatoes"),
    (f"<main><div class=menu>{LINKS}</div><div class=search>Search: <input></div><article><p>{LONG}</p></article></main>", LONG),
    (f"<p>{LONG}</p><!-- <p>no</p> --><![CDATA[ x ]]><p style='display: none'>no</p><p hidden>no</p><p aria-hidden=true>no</p><p>end</p>", f"{LONG}\nx\nend"),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages(k):
    assert html_text.extract(PAGES[k][0], WEIGHTS) == PAGES[k][1]


def test_frame(spark):
    rows = [(i, None if i % 2 else "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(3, "u", PAGES[3][0], "x")] * 2 + [(None, None, "<p>no id", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string")
    got = sorted((r.page_id if r.page_id is not None else -1, r._main) for r in html_text.extract_pages(df, ["page_id", "url"]).collect())
    assert got == sorted([*((i, w) for i, (_, w) in enumerate(PAGES)), (3, PAGES[3][1]), (3, PAGES[3][1]), (-1, "no id")])
    assert html_text.extract_pages(df.limit(0), ["page_id"]).count() == 0


def test_very_long_pages():
    many = "".join(f"<p>{LONG}</p>" for _ in range(40_000))
    assert html_text.extract(f"<nav>{'<a href=x>y</a>' * 50_000}</nav><article>{many}</article>", WEIGHTS) == "\n".join([LONG] * 40_000)
    for bad in ("<div>" * 50_000, "</div>" * 50_000, "<div a=" * 50_000, '<p class="' * 50_000, "<" * 200_000, "<a><b>" * 30_000, "<!--" * 50_000):
        html_text.extract(bad + "<p>x", WEIGHTS)


def test_deeply_nested_headings():
    deep = 20_000
    for a, b in (("<div>", "<h1>x</h1>"), ("<div class=ad>", "<h1>x</h1>"), ("<div class=ad>", "<article>"), ("<div class=ad>", "<main><h1>x</h1></main>")):
        at = time.process_time()
        html_text.extract(a * deep + b * 2000, WEIGHTS)
        assert time.process_time() - at < 2


def test_lists_of_links_and_inner_menus_of_held_out_pages():
    rng = random.Random(5)
    right = found = there = 0
    for _ in range(200):
        words = lambda a, b: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(a, b)))
        names = [words(1, 4) for _ in range(rng.randint(5, 30))]
        listed = rng.choice(["<ul>{}</ul>", "<p>{}</p>", "<div>{}</div>"]).format(" ".join((f"<li><a href=x>{x}</a></li>" if rng.random() < 0.5 else f"<a href=x>{x}</a>") for x in names))
        dishes = [words(4, 12) for _ in range(rng.randint(3, 9))]
        menu = f"<section class='{rng.choice(['menu', 'lunch-menu', 'menus', 'search'])}'>" + "".join(f"<p>{x}</p>" for x in dishes) + "</section>"
        lead, end = words(15, 60), words(8, 30)
        page = f"<ul>{''.join(f'<li><a href=y>{words(1, 2)}</a></li>' for _ in range(8))}</ul><article><h1>{(head := words(3, 6))}</h1><p>{lead}</p>{listed}{menu}<p>{end}</p></article><div class='menu'>{words(3, 9)}</div><footer>{words(3, 9)}</footer>"
        want = " ".join([head, lead, *names, *dishes, end])
        a, b = (collections.Counter(x.split()) for x in (html_text.extract(page, WEIGHTS), want))
        right, found, there = right + (a & b).total(), found + a.total(), there + b.total()
    assert right >= 0.97 * found and right >= 0.97 * there


VOCABULARY = "stone river answers under seven bright the of and a to in is was for old garden letter ocean paint silent tower north".split()


def held_out_page(rng):
    """A page of another build than the labelled ones, and its article."""
    words = lambda a, b: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a class="l" href="/{rng.random()}">{words(1, 3)}</a>'
    kinds = [
        lambda: (f"<p>{(x := words(15, 60))}.</p>", [x + "."]),
        lambda: (f"<h3>{(x := words(2, 6))}</h3>", [x]),
        lambda: (lambda rows: ("<table><tbody>" + "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in rows) + "</tbody></table>", [y for r in rows for y in r]))([(words(1, 2), words(1, 2)) for _ in range(rng.randint(2, 9))]),
        lambda: (lambda items: ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", items))([words(1, 9) for _ in range(rng.randint(2, 6))]),
        lambda: (lambda a, b, c: (f'<p>{a} <a href="z">{b}</a> {c}</p>', [f"{a} {b} {c}"]))(words(8, 30), words(1, 3), words(4, 20)),
        lambda: (f"<blockquote><p>{(x := words(6, 20))}</p></blockquote>", [x]),
    ]
    parts = [(f"<h1>{(t := words(3, 8))}</h1>", [t]), kinds[0](), *(rng.choice(kinds)() for _ in range(rng.randint(3, 10))), kinds[0]()]
    body, want = "".join(x for x, _ in parts), [y for _, ys in parts for y in ys]
    body = rng.choice(["{}", "<main>{}</main>", '<div id="story"><div class="text">{}</div></div>', '<section class="content-header-none">{}</section>', "<article class='post'>{}</article>"]).format(body)
    top = rng.choice([f"<header><a href=/>{words(1, 3)}</a></header>", f"<div class='site-header'>{words(1, 4)}</div>", "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(8)) + "</ul>", f"<div class='topbar'><span>{link()}</span></div>", "<div role=navigation>" + link() * 5 + "</div>"])
    side = rng.choice(["", f"<aside><h3>{words(2, 3)}</h3><p>{words(5, 20)}</p></aside>", f"<div class='widget sidebar'>{words(10, 30)}</div>", f"<div class='ad-slot'>{words(3, 9)}</div>"])
    end = rng.choice([f"<footer>{words(3, 12)}</footer>", f"<div id='comments'><p>{words(4, 40)}</p><p>{words(4, 40)}</p></div>", "<div>" + " | ".join(link() for _ in range(5)) + "</div>", f"<form><label>{words(1, 3)}</label><input><button>Go</button></form>", f"<div class='related-posts'>{link()}{link()}</div>"])
    return f"<!doctype html><html><head><title>{t}</title><style>p {{}}</style></head><body>{top}{side}{body}{end}{rng.choice(['', '<script>f(1)</script>'])}</body></html>", "\n".join(want)


def test_held_out_precision_and_recall():
    rng = random.Random(11)
    right = found = there = 0
    for _ in range(300):
        page, want = held_out_page(rng)
        a, b = (collections.Counter(x.split()) for x in (html_text.extract(page, WEIGHTS), want))
        right, found, there = right + (a & b).total(), found + a.total(), there + b.total()
    assert right >= 0.97 * found and right >= 0.97 * there


def test_labelled_pages_come_out_whole():
    for page in html_text.LABELLED:
        content = page.split("<!--[-->")[1].split("<!--]-->")[0]
        assert html_text.extract(page, WEIGHTS) == html_text.extract(f"<article>{content}</article>", WEIGHTS)


def test_region_is_the_best_one():
    rng = random.Random(2)
    weights = {"w": 1.0, "x": -2.0, "a": 0.5, "t": -0.7, ">": -0.25}
    for _ in range(200):
        toks = [rng.choice([("w", "a b", 2), ("w", "a", 1), ("x", "n", 1), ("<", "p", 0), (">", "p", 0), ("a", "l", 1)]) for _ in range(rng.randint(0, 14))]
        value = [weights["t"] if k == "<" else weights[">"] if k == ">" else weights["x"] if k == "x" else weights[k] * n for k, _, n in toks]
        a, b = html_text.region(toks, weights)
        assert sum(value[a:b]) == pytest.approx(max([0.0] + [sum(value[i:j]) for i, j in itertools.combinations(range(len(value) + 1), 2)]))


def test_ties_take_the_longest_of_the_first_regions():
    weights = {"w": 1.0, "x": -1.0, "t": -1.0, ">": -1.0}
    w, t = ("w", "a", 1), ("<", "p", 0)
    assert html_text.region([t, w, t, w, t], weights) == (0 + 1, 4) and html_text.region([w, w, t, t, w, w], weights) == (0, 6)


def test_weights_have_the_named_signs():
    assert WEIGHTS["w"] > 0 and all(v < 0 for k, v in WEIGHTS.items() if k.startswith("t") or k in ">x")
