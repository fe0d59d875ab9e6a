import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from metricloom.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(x.values()) for x in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for x in counts for t in x)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), tf, size in zip(docs, counts, sizes):
            if size:
                m = 10 + 90 * size * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
                if s > 0:
                    scored.append((-s, doc is None, doc if doc is not None else 0))
        out += [(item, i + 1, None if x[1] else x[2], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return out


def tables(seed, n_docs=150, n_items=25, vocabulary=60):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["É", "日本", "ABC"]
    odds = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: random.choice([" ", "-", ", "]).join(random.choices(vocab, odds, k=n))
    docs = [(i, text(random.randrange(1, 80))) for i in range(n_docs)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (900, docs[9][1]), (901, docs[9][1]), (902, None), (903, ""), (904, "-- !"), (905, text(5000))]
    items = [(i, text(random.randrange(1, 30))) for i in range(n_items)] + [(3, "w1 w2"), (None, "w5 w7"), (50, None), (51, "..."), (52, "absent"), (53, docs[11][1])]
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS score").repartition(4)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return [tuple(r) for r in S.search(d, i, **kw).collect()]


def test_equals_brute_force(spark, monkeypatch):
    docs, items = tables(1)
    assert sorted(run(spark, docs, items), key=str) == sorted(brute(docs, items), key=str)
    monkeypatch.setattr(S, "BLOCK_TERMS", 100)
    assert sorted(run(spark, docs, items, k=3), key=str) == sorted(brute(docs, items, 3), key=str)


def test_empty_tables(spark):
    docs, items = tables(2, 12, 3)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == []
    assert run(spark, docs, [(1, "absent")]) == []


def test_text_keys(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "k string, body string")
    i = spark.createDataFrame([("x", "two")], "q string, text string")
    assert [tuple(r)[:3] for r in S.search(d, i, "k", "body", "q").orderBy("rank").collect()] == [("x", 1, "a"), ("x", 2, "b")]




def test_stops_early_and_exactly():
    rng = np.random.default_rng(5)
    saved = 0
    for trial in range(30):
        n, slots = 3000, 4
        lists = [np.sort(rng.choice(n, int(rng.integers(50, n)), replace=False)) for _ in range(slots)]
        row, slot = np.concatenate(lists), np.repeat(np.arange(slots), [len(x) for x in lists])
        count = rng.zipf(1.5 if trial % 2 else 4, len(row)).clip(max=1000).astype(np.int64)
        m = rng.integers(10, 200, n)
        s = S.Shard(pa.array(np.arange(n)), m, row, slot, count, slots)
        w = rng.integers(0, 3000, slots)
        total = np.zeros(n, np.int64)
        np.add.at(total, row, w[slot] * (S.SCALE * count // (1000 * count + 8 * m[row])))
        want = np.lexsort((np.arange(n), -total))[:10]
        scores, docs, work = s.best(np.arange(slots), w, 10, 1)
        good = scores > 0
        assert docs[good].tolist() == [x for x in want if total[x] > 0] and scores[good].tolist() == [t for t in total[want] if t > 0]
        saved += work < slots * len(np.unique(row))
    assert saved > 10
