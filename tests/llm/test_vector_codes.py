import math
import random

import numpy as np

from metricloom.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, NEAR string"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd rounds in Python integers."""
    good = [(k, [math.floor(1024 * x) for x in v], g) for k, v, g, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    w = len(good[0][1]) // parts
    books = [[r[1][p * w : p * w + w] for r in good[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            cells = {}
            for _, q, _ in good:
                x = q[p * w : p * w + w]
                cells.setdefault(near(p, x)[1], []).append(x)
            for i, xs in cells.items():
                books[p][i] = [sum(col) // len(col) for col in zip(*xs)]
    out = []
    for k, q, g in good:
        best = [near(p, q[p * w : p * w + w]) for p in range(parts)]
        out.append((k, [b[1] for b in best], [b[0] for b in best], g))
    return out, books


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    out, books = V.compress(df, columns=["label", "NEAR"], **kw)
    want, want_books = brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for k, v, g in rows], **kw)
    assert books.tolist() == want_books
    got = [(r["vec_id"], r["entries"], r["distances"], r["label"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return out


def test_equals_plain_rounds(spark):
    random.seed(2)
    rows = [(k, [random.gauss(random.choice([-1, 0, 1]), 0.2) for _ in range(8)], random.choice([1, 1, 2, None])) for k in range(120)]
    rows += rows[:7] + [(300, None, 1), (-5, [0.5] * 3 + [float("nan")] + [0.0] * 4, 1), (-4, [float("inf")] * 8, 1), (-3, [None] + [0.1] * 7, 2), (-6, [], 1), (9, [0.1] * 12, 1)]
    rows += [(None, [0.25] * 8, 2), (2, [0.3] * 8, 1), (310, [900.5, -900.5] * 4, 1)]
    check(spark, rows, entries=16)
    check(spark, rows, entries=256, rounds=2)
    check(spark, rows, parts=2, entries=5, rounds=6)


def test_coarse_grid_has_many_ties(spark):
    random.seed(4)
    rows = [(k, [random.randrange(4) / 1024 for _ in range(8)], 1) for k in range(200)]
    check(spark, rows, entries=12)


def test_only_moved_entries_are_compared():
    random.seed(6)
    rng = np.random.default_rng(1)
    x, book = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (32, 4))
    entry, far = np.full(500, -1), np.zeros(500, np.int64)
    V.nearest(x, book, np.ones(32, bool), entry, far)
    new = book.copy()
    new[[3, 9]] += 5
    moved = (new != book).any(axis=1)
    full = (~np.isin(entry, [3, 9])).sum() * 2 + np.isin(entry, [3, 9]).sum() * 32
    assert V.nearest(x, new, moved, entry, far) == full
    d = ((x[:, None] - new[None]) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert V.nearest(x, new, np.zeros(32, bool), entry, far) == 0


def test_wide_numbers_are_exact():
    x = np.array([[1 << 24, -(1 << 24)], [5, 7]])
    assert V.distances(x, -x).tolist() == [[4 * (1 << 48) * 2, (2**24 + 5) ** 2 + (7 - 2**24) ** 2], [(5 + 2**24) ** 2 + (7 - 2**24) ** 2, 100 + 196]]


def test_group_sums_both_ways(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, None, 7), (4, None, 8), (5, 2, 1)], "vec_id int, label int, error bigint")
    want = [(1, 11), (2, 11), (3, 15), (4, 15), (5, 1)]
    for small in (10, 0):
        monkeypatch.setattr(V, "SMALL", small)
        out = V.with_group_sum(rows, "label", "error", "label_error")
        assert sorted((r["vec_id"], r["label_error"]) for r in out.collect()) == want


def test_empty(spark):
    out, books = V.compress(spark.createDataFrame([], SCHEMA), columns=["label"])
    assert out.count() == 0 and books.size == 0 and V.codebooks_digest(books)
    out, books = V.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x")], SCHEMA))
    assert out.count() == 0
