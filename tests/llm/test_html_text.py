"""Extraction on hand-made pages, and the cut against all labellings."""

import itertools
import random
import time

import numpy as np

from spanloom.llm.html_text import PRECISION, PRIOR, extract, fitted, least_cut, main_text, trained

LONG = "This is a paragraph of some length that says what the page is about, in words."


def page(inner, around=""):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{around}{inner}</body></html>"


def test_cut_is_the_least_of_all():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 8)
        terminals = [r.randrange(-6, 7) for _ in range(n)]
        edges = [(a, b, r.randrange(1, 5)) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(sides, terminals=terminals, edges=edges):
            return sum(abs(c) for c, s in zip(terminals, sides, strict=True) if c and (c > 0) != s) + sum(c for a, b, c in edges if sides[a] != sides[b])

        assert cost(least_cut(terminals, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_article_without_what_is_around():
    html = page(
        f"<article><h1>Title</h1><p><b>{LONG}<br><p>Short.</p><div class='ad'>Buy it now.</div><p>Fish &amp; chips&nbsp;&eacute;\n here.</p></article>",
        "<header><h2>Site name</h2></header><nav><ul><li><a href='/'>Home</a><li><a href='/x'>X</a></ul></nav><div class='cookie-notice'>We use cookies on this site.</div>",
    ).replace("</body>", f"<aside><p>{LONG}</p></aside><section id='comments'><p>{LONG}</p></section><form><p>Name <input></p></form><footer>&copy; me</footer>")
    assert main_text(html) == f"Title\n\n{LONG}\n\nShort.\n\nFish & chips é here."


def test_pages_without_article_elements():
    html = page(f"<div id='content'><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><ul><li>one point<li>another point</ul></div>", "<div id='menu'><a href=a>A</a> <a href=b>B</a></div>")
    html = html.replace("</body>", f"<div class='sidebar'><p>{LONG}</p></div><div class='footer'>All rights</div></body>")
    assert main_text(html) == f"Head\n\n{LONG}\n\nYes.\n\n{LONG}\n\none point\n\nanother point"


def test_comments_inside_the_article_and_hidden_parts():
    html = page(f"<main><p>{LONG}</p><div hidden>secret</div><p style='display: none'>secret</p><div class='reader-comments'><p>{LONG} I say.</p></div></main>")
    assert main_text(html) == LONG


def test_cost_grows_with_the_page_not_with_its_depth():
    def seconds(n):
        start = time.process_time()
        main_text("<div>some words of text </b>" * n)
        return time.process_time() - start

    seconds(100)
    assert seconds(16000) < 40 * seconds(1000) + 0.5


def test_odd_pages(spark):
    deep = "<div>" * 3000 + f"<article><p>{LONG}" + "</div>" * 10
    cases = [None, "", "plain words only", "<", "<p", "<!-- open", "<script>var x", "<p>" * 5000, deep, "&#0;&bogus;&#x110000;", "</p></div>", f"<article><p>{LONG}</p>" * 300]
    rows = spark.createDataFrame([(k, None, h, 1) for k, h in enumerate(cases)] + [(0, "u", None, 1)], "page_id long, url string, html string, text int")
    got = extract(rows).collect()
    assert len(got) == len(cases) + 1
    by_id = {x.page_id: x for x in got if x.url is None}
    assert by_id[0].text == "" and by_id[0].n_chars == 0
    assert by_id[8].text == LONG
    assert by_id[11].text == "\n\n".join([LONG] * 300)
    assert all(x.n_chars == len(x.text) for x in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_classifier_learns_from_labelled_blocks_and_stays_near_its_prior_without_them(spark):
    r = random.Random(5)
    rows = np.array([[1.0, r.uniform(1, 6), r.random(), float(r.random() < 0.5), *[0.0] * (len(PRIOR) - 4)] for _ in range(2000)])
    content = rows[:, 2] + 0.1 * rows[:, 1] < 0.8
    weights = fitted(rows, content)
    share = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum()) * len(content)

    def loss(w):
        return (share * np.logaddexp(0, np.where(content, -1, 1) * (rows @ w))).sum() + PRECISION / 2 * ((w - PRIOR) ** 2).sum()

    least = loss(weights)
    assert all(least <= loss(weights + 0.01 * np.array([r.gauss(0, 1) for _ in PRIOR])) for _ in range(300))
    assert (((rows @ weights) > 0) == content).mean() > (((rows @ PRIOR) > 0) == content).mean()
    assert (fitted(rows, np.zeros(2000, bool)) == PRIOR).all()
    assert (trained(spark.createDataFrame([], "page_id long, url string, html string")) == PRIOR).all()
    plain = spark.createDataFrame([(1, None, f"<p>{LONG}</p>"), (None, None, None)], "page_id long, url string, html string")
    assert (trained(plain) == PRIOR).all()


def test_training_is_bounded_and_agrees_on_reruns(spark):
    html = f"<article><h1>T</h1>{f'<p>{LONG}</p>' * 30}</article><nav>{'<li><a href=a>A</a>' * 30}</nav>"
    pages = spark.createDataFrame([(k % 7, "u", html) for k in range(40)], "page_id long, url string, html string")
    first = trained(pages, learn_pages=4, learn_blocks=40)
    assert (first == trained(pages.repartition(5), learn_pages=4, learn_blocks=40)).all()
    assert (first != PRIOR).any()
