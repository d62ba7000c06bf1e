"""Marginals against sums over all labellings, the gradient against differences, extraction against known pages."""

from itertools import product

import numpy as np
import pytest
from lodestone.llm import html_text as H
from lodestone.llm.html_tree import parse

SOME = "<html><body><nav><a href=x>Menu</a></nav><div class=box><h1>Head</h1><p>Some text, at last.</p>tail</div><footer>Foot</footer></body></html>"


def plain_score(forest, weights, labels):
    edge = weights[H.WIDE :].reshape(-1, 4)
    total = 0.0
    for i, y in enumerate(labels):
        total += y * float(forest.x[i] @ weights[: H.WIDE])
        p = forest.parent[i]
        if p >= 0 and not forest.empty[i]:
            both = {(1, 1): 0, (0, 0): 1, (1, 0): 2, (0, 1): 3}[labels[p], y]
            total += edge[forest.kind[i], both]
    return total


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    forest = H.Forest([parse(SOME), parse("<p>one<p>two")])
    weights = rng.standard_normal(len(H.PRIOR))
    n = len(forest.parent)
    scored = [(labels, np.exp(plain_score(forest, weights, labels))) for labels in product((0, 1), repeat=n)]
    all_of = sum(s for _, s in scored)
    node, pair = H.marginals(forest, weights)
    for i in range(n):
        assert node[i, 1] == pytest.approx(sum(s for y, s in scored if y[i]) / all_of)
        if forest.parent[i] >= 0:
            for a, b in product((0, 1), repeat=2):
                assert pair[i, a, b] == pytest.approx(sum(s for y, s in scored if (y[forest.parent[i]], y[i]) == (a, b)) / all_of)


def test_gradient():
    rng = np.random.default_rng(1)
    pages = [parse(SOME)]
    forest = H.Forest(pages)
    labels = H.labels_of(forest, pages, ["Head\nSome text, at last.\ntail"])
    assert [(pages[0].text[i], int(y)) for i, y in enumerate(labels) if pages[0].text[i]] == [("Menu", 0), ("Head", 1), ("Some text, at last.", 1), ("tail", 1), ("Foot", 0)]
    weights = rng.standard_normal(len(H.PRIOR))
    n = len(forest.parent)

    def likelihood(w):
        return plain_score(forest, w, labels) - np.log(sum(np.exp(plain_score(forest, w, y)) for y in product((0, 1), repeat=n)))

    got = H.gradient(forest, labels, weights)
    for k in rng.choice(len(weights), 12, replace=False):
        step = np.zeros(len(weights))
        step[k] = 1e-5
        assert got[k] == pytest.approx((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, abs=1e-4)


def body(i):
    return [f"Headline number {i}", "It was a long day, and nobody in the town had seen anything like it before.", "Be.", f'"Yes & no," they said <{i}>; the river rose again in the night.', "The council met at noon and left at two."]


def html_of(lines):
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    return f"<h1>{esc(lines[0])}</h1>" + "".join(f"<p>{esc(t)}</p>" for t in lines[1:])


LAYOUTS = {
    "article": '<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now and save a lot.</div><article>{}</article><footer>&copy; us</footer>',
    "boxes": '<body><div id="top-nav"><a href="/a">Home</a> <a href="/b">News</a></div><div class="content">{}</div><div class="sidebar"><h3>Related</h3><ul><li><a href=x>More of it</a></li></ul></div><div id="footer">All rights reserved.</div>',
    "main": '<body><header><a href="/">Site</a><form action=/s><input name=q><button>Go</button></form></header><main>{}</main><aside><p>Also read this one here.</p></aside><footer>Contact</footer>',
    "comments": '<body><article>{}<div class="ad-slot">Advert text.</div><form><label>Mail</label><input></form></article><section id="comments"><h2>Comments</h2><article class="comment"><p>I liked it very much, thank you all.</p></article></section>',
    "teasers": '<body><header class="site-header"><div class="logo">Site</div></header><main><article>{}</article><section class="related"><article class="card"><h4><a>Other</a></h4><p>Its teaser reads like so, a sentence of some length.</p></article></section></main>',
    "inner": '<body><article>{}<aside><p>Did you know this thing, which is quite long and reads as a sentence?</p></aside><nav class="toc"><a>Part</a></nav><footer>Tags</footer></article>',
    "named": '<body><div id="page"><div id="header"><p>The best site for news, every day.</p></div><div id="main"><div class="entry-content">{}</div><ol class="comment-list"><li><p>I do not agree with this at all, my friend.</p></li></ol></div></div>',
    "notice": '<body><div class="cookie-banner"><p>We use cookies to make this better for you.</p><button>Accept</button></div><div class="wrap"><div class="post-body">{}</div></div><script>var x="<p>no</p>";</script><style>p{{}}</style><!-- <p>never</p> -->',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    marked = [("<!DOCTYPE html><html>" + LAYOUTS["article"].format(html_of(body(i))), "\n".join(body(i))) for i in range(40)]
    assert all(H.marked_text(h) == t for h, t in marked)
    for weights in (H.PRIOR, H.fit(marked)):
        for i in range(3):
            page = parse("<!DOCTYPE html><html><head><title>T</title></head>" + LAYOUTS[layout].format(html_of(body(i))))
            assert H.extract([page], weights)[0] == "\n".join(body(i))


def test_broken_markup():
    p = parse("<p><b>One<br>and\n\t two&nbsp;&amp;amp; &am &#65;<br><p>Three</i></div><li>4<li>5<table><tr><td>6<td>7</table><a title=\"a>b\" class=it's>8</a> 9 <3 <noscript>no</noscript>10<script>11")
    assert [t for t in p.text if t] == ["One and two && &am A".replace("&&", "&amp;"), "Three", "4", "5", "6", "7", "8 9 <3 10"]
    assert [t for t in parse("a<!-- b <p>c").text if t] == ["a"] and [t for t in parse("x<p y='").text if t] == ["x"]
    deep = parse("<div>" * 3000 + "in" + "</div>" * 2999)
    assert H.extract([deep], H.PRIOR) is not None and deep.text[-1] == "in"


def test_query_on_odd_rows(spark):
    from lodestone.llm.html_text import main_text, marked_pages, train

    page = LAYOUTS["article"]
    rows = [(i, f"u{i}", page.format(html_of(body(i))), "clash", 1) for i in range(30)] + [(None, None, None, None, None), (31, "u", "", "c", 2), (1, "u1", page.format(html_of(body(1))), "clash", 1), (33, "u", "plain words, no markup at all", "c", 3)]
    long = body(7) * 20_000
    rows.append((40, "long", page.format(html_of([long[0], *long])), "c", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    weights = train(marked_pages(df))
    got = main_text(df, weights).collect()
    assert main_text(df, weights).columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert all(by_id[i]["text"] == "\n".join(body(i)) and by_id[i]["n_chars"] == len(by_id[i]["text"]) for i in range(30))
    assert by_id[None]["text"] == by_id[31]["text"] == "" and by_id[40]["text"] == "\n".join([long[0], *long])
    assert sum(r["page_id"] == 1 for r in got) == 2
    assert main_text(df.limit(0), weights).collect() == [] and (train(marked_pages(df.limit(0))) == H.PRIOR).all()
