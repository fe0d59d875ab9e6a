import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import groups
from metricloom.llm import embedding_dedup as V


def brute(rows, threshold=0.93):
    unit = []
    for _, label, v in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    comp = groups(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        least[comp[i]] = min(r[0], least.get(comp[i], r[0]))
    n = np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted((r[0], int(n[i]), least[comp[i]], r[0] == least[comp[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("leaf", [1024, 24])
def test_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(V, "LEAF", leaf)
    monkeypatch.setattr(V, "SMALL", leaf // 8)
    rng = np.random.default_rng(leaf)
    rows, k = [], 0
    centers = rng.normal(size=(6, 8))
    for label, count, noise in ((1, 150, 0.05), (1, 120, 0.35), (2, 60, 0.3), (None, 10, 0.1)):
        for _ in range(count):
            v = centers[rng.integers(6)] + noise * rng.normal(size=8) if rng.random() < 0.8 else rng.normal(size=8)
            rows.append((k, label, [float(np.float32(x)) for x in v * 10.0 ** rng.integers(-3, 4)]))
            k += 1
    rows += [(k + i, 1, rows[0][2]) for i in range(5)]
    rows += [(900, 1, None), (901, 1, [0.0] * 8), (902, 1, [1.0, None]), (903, 1, [float("nan")] * 8), (904, 1, [float("inf"), 1.0]), (905, 1, [])]
    rows += [(906, 1, [1.0, 0.0]), (907, 1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = V.similar_vectors(df.selectExpr("*", "'x' AS kept"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_vectors_before_unusable_ones(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [1.0, 0.0, 0.11], [1.0, 0.01, 0.12], [1.0, 0.02, 0.1], [1.0, 0.02, 0.11]]
    bad = [[0.0, 0.0, 0.0], [nan, 1.0, 1.0], [1.0, None, 1.0], [1.0, -inf, 0.0], None, []]
    rows = [(2 * i + k, 1, v) for i, pair in enumerate(zip(good, bad)) for k, v in enumerate(pair)]
    rows += [(20, 1, good[0]), (21, 1, bad[0]), (22, 1, bad[1]), (23, 1, good[1])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").coalesce(1)
    units = [r["u"] for r in df.select(V.unit(F.col("embedding")).alias("u")).collect()]
    assert [u is None for u in units] == [v in bad for _, _, v in rows] and {len(u) for u in units if u} == {3}
    assert sorted(map(tuple, V.similar_vectors(df).collect())) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert V.similar_vectors(df).count() == 0
