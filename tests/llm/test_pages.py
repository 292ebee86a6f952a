import random

import numpy as np
import pytest

from corpusloom.llm import html_extract

KIND = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.page_texts(spark.createDataFrame(rows, KIND)).collect()}


def story(i, j=0):
    return f"Story {i} part {j} " + " ".join(f"w{(i * 31 + j * 7 + k) % 997}" for k in range(12))


def test_template_decides_without_an_article_and_inside_one(spark, monkeypatch):
    """Unmarked boilerplate of several layouts, constant prose inside articles, and many texts under one node."""
    plain = "<body><div><p>Welcome to our site</p></div><div><p>{0}</p><p>{1}</p></div><div><p>All rights reserved</p></div></body>"
    other = "<body><section><h2>Today</h2><p>{0}</p></section><section><p>Call us now</p></section></body>"
    inside = "<body><article><h1>{0}</h1><p>{1}</p><p>Like what you read? Tell a friend.</p></article></body>"
    many = "<body><div>" + "".join(f"fixed {j}<hr>" for j in range(80)) + "{0}</div></body>"
    rows = [(i, "http://two.x/p", (plain if i % 3 else other).format(story(i), story(i, 1))) for i in range(24)]
    rows += [(100 + i, "http://in.x/p", inside.format(story(i), story(i, 1))) for i in range(6)]
    rows += [(200 + i, "http://many.x/p", many.format(story(i))) for i in range(6)]
    want = {i: f"{story(i)}\n\n{story(i, 1)}" if i % 3 else story(i) for i in range(24)}
    want |= {100 + i: f"{story(i)}\n\n{story(i, 1)}" for i in range(6)} | {200 + i: story(i) for i in range(6)}
    assert texts(spark, rows) == want
    monkeypatch.setattr(html_extract, "MIN_PAGES", 10_000)
    without = texts(spark, rows)
    assert all("All rights reserved" in without[i] or "Call us now" in without[i] for i in range(24)) and "Tell a friend" in without[100] and "fixed 79" in without[200]


def test_copies_of_a_page_are_one_page(spark):
    """An article that a host repeats under many urls is still its text."""
    page = f"<body><article><h1>{story(1)}</h1><p>{story(1, 1)}</p></article></body>"
    rows = [(i, f"http://c.x/{i}", page) for i in range(12)] + [(20 + i, "http://c.x/o", page.replace(story(1), story(5 + i)).replace(story(1, 1), story(5 + i, 1))) for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"{story(1)}\n\n{story(1, 1)}" for i in range(12)) and got[21] == f"{story(6)}\n\n{story(6, 1)}"


def test_a_rare_odd_page_is_aligned_too(spark):
    usual = "<body><div><p>Welcome to our site</p></div><div><p>{0}</p></div></body>"
    odd = "<body><div><p>Welcome to our site</p></div><ul><li>x</li></ul><div><p>{0}</p></div></body>"
    rows = [(i, "http://o.x/p", (odd if i == 3 else usual).format(story(i))) for i in range(10)]
    got = texts(spark, rows)
    assert got[0] == story(0) and got[3] == f"x\n\n{story(3)}"


def plain_weight(a, b):
    """Simple tree matching as its definition says."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children):
        for j, d in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_weight(c, d))
    return 1 + m[-1][-1]


@pytest.mark.parametrize("cells", [40_000, 3])
def test_alignment_is_a_best_simple_tree_matching(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "CELLS", cells)
    rng = random.Random(8)

    def tree(depth):
        x = html_extract.Node("", rng.choice("ab"), False, False, False)
        x.children = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        html_extract._measure(x)
        return x

    for _ in range(150):
        a, b = tree(4), tree(4)
        a.label = b.label = "r"
        html_extract._measure(a)
        html_extract._measure(b)
        got = html_extract.align(a, html_extract.Reference(html_extract.skeleton(b)))
        assert len(got) == plain_weight(a, b) and len(set(got.values())) == len(got)


def test_very_long_and_odd_html(spark):
    long = "<article>" + "".join(f"<p>{story(j)}</p>" for j in range(8000)) + "</article>"
    rows = [(1, "http://l.x/", long), (2, None, "<p>a"), (3, "::", "<p>b"), (4, "http://l.x/", " "), (5, "http://l.x/", None), (5, "http://l.x/", None)]
    got = texts(spark, rows)
    assert got[1] == "\n\n".join(story(j) for j in range(8000)) and (got[2], got[3], got[4], got[5]) == ("a", "b", "", "")
    assert np.all([len(got[i]) < 2 for i in (2, 3, 4, 5)])
