import random

import numpy as np
import pytest

from brute import near_duplicates
from metricloom.llm import minhash_dedup as M


@pytest.mark.parametrize("length,large", [(2, 64), (5, 3), (2, 2)])
def test_against_brute_force(spark, monkeypatch, length, large):
    monkeypatch.setattr(M, "LARGE_GROUP", large)
    random.seed(length)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "É"), (7, "é"), (7, "a b"), (8, "A  B")]
    for base in range(12):
        text = [random.choice(vocabulary) for _ in range(random.randrange(10, 120))]
        for _ in range(random.randrange(1, 9)):
            copy = list(text)
            for _ in range(random.randrange(0, 1 + len(copy) // 8)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((random.randrange(10**6), " ".join(copy)))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS sig", "'x' AS t")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.near_duplicates(docs, length=length).collect())
    assert got == sorted(near_duplicates(rows, length))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = M.near_duplicates(docs, length=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(near_duplicates(rows, 2))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        a, b = x[:2000], x[500:2500]
        errors.append((M.signature(a) == M.signature(b)).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
