import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import vector_codes
from corpusloom.llm.vector_codes import Tree

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, group int"


@pytest.mark.parametrize("trial", range(12))
def test_trees_against_all_distances(trial):
    rng = np.random.default_rng(trial)
    n, k, size = int(rng.integers(1, 2500)), int(rng.integers(1, 65)), [2, 12, 200, 1 << 25][trial % 4]
    points = rng.integers(-size, size, (n, 4))
    if trial % 3 == 0:
        points[: n // 2] = points[0]
    entries = points[rng.integers(0, n, k)] if trial % 2 else rng.integers(-size, size, (k, 4))
    own, sums, counts = Tree(points).assign(entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (own == want).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    total = np.zeros_like(entries)
    np.add.at(total, want, points)
    assert (sums == total).all()


def test_whole_subtrees_are_assigned():
    """Two far groups: no point is compared by itself."""
    points = np.concatenate([np.zeros((500, 2), np.int64), np.full((500, 2), 1000)])
    entries, asked = np.array([[3, 3], [990, 990]]), []
    original = vector_codes._nearest
    vector_codes._nearest = lambda *a: asked.append(a) or original(*a)
    try:
        _, sums, counts = Tree(points).assign(entries)
    finally:
        vector_codes._nearest = original
    assert not asked and counts.tolist() == [500, 500] and sums.tolist() == [[0, 0], [500_000, 500_000]]


def brute(rows, parts, k, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: x[:2])[:k]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            took = {}
            for _, v, _ in kept:
                took.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(took[j]) for c in zip(*took[j], strict=True)] if j in took else e for j, e in enumerate(books[p])]
    out, errors = [], {}
    for i, v, label in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), label))
        errors[label] = errors.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label], digest) for i, c, e, label in out), key=repr)


def rows_of(n, width=32):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1 / 8, width).astype(np.float32)], int(rng.integers(0, 3))) for i in rng.permutation(n)]
    for i in range(0, n, 9):
        rows[i] = (rows[i][0], rows[0][1], None)
    if n > 20:
        rows[3] = (rows[3][0], None, 1)
        rows[4] = (rows[4][0], [*rows[4][1][:-1], math.nan], 1)
        rows[5] = (rows[5][0], [math.inf, *rows[5][1][1:]], 1)
        rows[6] = (rows[6][0], [None, *rows[6][1][1:]], 1)
        rows[7] = (None, rows[7][1], 2)
        rows += [rows[8], rows[8]]
    return rows


@pytest.mark.parametrize("n", [1, 30, 400])
def test_against_brute_force(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = vector_codes.code_digest(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 16, 64, 2)


def test_round_trip_and_odd_rows(spark):
    rows = [*((i, [i / 64] * 16, 0) for i in range(20)), (90, [1.0] * 8, 0), (91, [1e9] * 16, 0), (92, [], 0)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    books = vector_codes.fit(df)
    got = {r.vec_id: r for r in vector_codes.decode(vector_codes.encode(df, books), books).collect()}
    assert got[7].approximation == [7 / 64] * 16 and got[7].error == 0 and got[7].code == "07" * 16
    assert len(got) == 23 and all(got[i].code is got[i].error is got[i].approximation is None for i in (90, 91, 92))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(df.where("vec_id = 90"))


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA)
    assert vector_codes.fit(empty) is None and vector_codes.code_digest(empty).count() == 0
    assert vector_codes.code_digest(empty.limit(0)).count() == 0
