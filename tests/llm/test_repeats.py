import random

import pytest
from pyspark.sql import functions as F

from brute import repeats
from metricloom.llm import substring_dedup as S


@pytest.mark.parametrize("window", [2, 6, 35])
def test_against_brute_force(spark, window):
    random.seed(window)
    passage = [f"p{i}" for i in range(3 * window)]
    texts = [None, "", "   ", "one", " ".join(passage), " ".join(passage), " ".join(passage[: window - 1])]
    for _ in range(60):
        w = [f"w{random.randrange(12 if window < 10 else 10**6)}" for _ in range(random.randrange(3 * window))]
        a = random.randrange(len(passage))
        at = random.randrange(len(w) + 1)
        texts.append(random.choice([" ", "\n", "\t "]).join(w[:at] + passage[a : a + random.randrange(2 * window)] + w[at:]))
    texts += [" ".join(["a"] * (window + 1)), " ".join(f"q{i}" for i in list(range(window)) * 2)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, t string")
    got = S.remove_repeats(docs, window=window).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == repeats(texts, window)


def test_empty_table_and_uncut_text(spark):
    docs = spark.createDataFrame([(1, "a  b\nc"), (None, "a  b\nc"), (2, "x " * 40)], "doc_id bigint, text string")
    got = S.remove_repeats(docs, window=35, joined=False).collect()
    assert sorted(r["kept"] for r in got) == ["", "a  b\nc", "a  b\nc"]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_covers():
    for period, cover in S.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for window in range(1, 80):
        period, _, length = S.cover_for(window)
        assert length + period - 1 == window and length >= 1


def test_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(8))
    docs = spark.createDataFrame([(1, words, "a", 2, "b"), (2, words, "a", 2, "b")], "doc_id bigint, text string, _t string, _U int, _starts string")
    out = S.remove_repeats(docs, window=5)
    assert [x for x in out.columns if x.startswith("_")] == ["_t", "_U", "_starts"]
    assert [(r["_t"], r["_U"], r["n_removed"]) for r in out.collect()] == [("a", 2, 8), ("a", 2, 8)]
