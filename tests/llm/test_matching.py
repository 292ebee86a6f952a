"""Tree matching of long unlike lists: the same matches, in bounded time and memory."""

import random
import time
import tracemalloc

import pytest

from corpusloom.llm import html_extract
from corpusloom.llm.html_extract import Node, Reference, align, skeleton


def measured(label, *children):
    x = Node("", label, False, False, False)
    x.children = list(children)
    html_extract._measure(x)
    return x


def grown(rng, depth, most):
    children = [grown(rng, depth - 1, most) for _ in range(rng.randrange(most + 1))] if depth else []
    return measured(rng.choice("abc"), *children)


def entry(rng, label="li"):
    """A list entry of its own kind: a few parts, each with a few."""
    return measured(label, *[measured(rng.choice("pqrst"), *[measured(rng.choice("uvwxyz")) for _ in range(rng.randrange(4))]) for _ in range(rng.randrange(1, 5))])


@pytest.mark.parametrize("seed", range(6))
def test_together_as_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    a, b = (measured("root", *[grown(rng, 3, 4) for _ in range(25)]) for _ in range(2))
    reference = Reference(skeleton(b))
    found = {}
    for together in (0, 10**9):
        monkeypatch.setattr(html_extract, "TOGETHER", together)
        monkeypatch.setattr(html_extract, "STEP", 50 if seed % 2 else 2 << 20)
        found[together] = (html_extract._weight(a, reference.root, {}), align(a, reference))
    assert found[0] == found[10**9] and found[0][0] == len(found[0][1])
    monkeypatch.setattr(html_extract, "TOGETHER", 0)
    monkeypatch.setattr(html_extract, "TABLE", 100)  # too large: one by one
    assert html_extract._weight(a, reference.root, {}) == found[0][0]


def timed(a, b):
    reference = Reference(skeleton(b))
    tracemalloc.start()
    began = time.process_time()
    found = align(a, reference)
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return len(found), took, most / 1e6


def test_long_unlike_lists_end():
    rng = random.Random(1)
    a, b = (measured("ul", *[entry(rng) for _ in range(1500)]) for _ in range(2))
    n, took, mb = timed(a, b)
    assert n > 3000 and took < 60 and mb < 200


def test_labels_of_their_own_cost_nothing():
    a = measured("ul", *[measured(f"li.a{i}", measured("p")) for i in range(6000)], measured("li", measured("p")))
    b = measured("ul", *[measured(f"li.b{i}", measured("p")) for i in range(6000)], measured("li", measured("p"), measured("q")))
    n, took, mb = timed(a, b)
    assert n == 3 and took < 10 and mb < 50
    c = measured("ul", *[measured(f"li.a{i}", measured("p"), measured("q")) for i in range(5000)])
    d = measured("ul", *[measured(f"li.a{i}", measured("p"), measured("r")) for i in range(5000)])
    n, took, mb = timed(c, d)
    assert n == 1 + 2 * 5000 and took < 60 and mb < 200
