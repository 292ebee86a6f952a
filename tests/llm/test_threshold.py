"""The quality threshold by kinds of rows."""

import numpy as np

from corpusloom.llm import quality
from corpusloom.llm.quality import GOOD, LOW, TOXIC, threshold_of


def scores(**kinds):
    p = np.concatenate(list(kinds.values()))
    label = np.concatenate([np.full(len(v), {"good": GOOD, "low": LOW, "toxic": TOXIC}[k]) for k, v in kinds.items()])
    return p, label


def shares(t, p, label):
    return {k: float((p[label == k] >= t).mean()) for k in (GOOD, LOW, TOXIC) if (label == k).any()}


def test_half_where_it_does():
    p, label = scores(good=np.linspace(0.7, 1, 200), low=np.linspace(0, 0.3, 50), toxic=np.linspace(0, 0.4, 50))
    assert threshold_of(p, label) == 0.5


def test_toxic_rows_raise_it_by_themselves():
    """They are few beside the low-quality ones, and judged apart from them."""
    p, label = scores(good=np.linspace(0.8, 1, 200), low=np.zeros(500), toxic=np.linspace(0.3, 0.9, 50))
    t = threshold_of(p, label)
    got = shares(t, p, label)
    assert t > 0.5 and got[TOXIC] <= 1 - quality.CATCH and got[GOOD] >= quality.LEAST_KEPT


def test_good_rows_come_first():
    p, label = scores(good=np.linspace(0.55, 1, 300), toxic=np.linspace(0.55, 1, 60))
    got = shares(threshold_of(p, label), p, label)
    assert quality.LEAST_KEPT <= got[GOOD] < 0.98 and got[TOXIC] > 0.9


def test_good_rows_lower_it():
    p, label = scores(good=np.r_[np.linspace(0.3, 0.5, 30), np.linspace(0.5, 1, 70)], low=np.zeros(10))
    assert threshold_of(p, label) < 0.35
