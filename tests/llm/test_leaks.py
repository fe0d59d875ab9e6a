import random

import numpy as np

from metricloom.llm import decontaminate as X

D = "/root/testdata/sf0.01"


def edits(a, b):
    """Least edits of a against any stretch of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_exact_edits():
    random.seed(2)
    for _ in range(200):
        a = np.array([random.randrange(4) for _ in range(random.randrange(1, 9))], np.uint64)
        b = np.array([random.randrange(4) for _ in range(random.randrange(0, 14))], np.uint64)
        n, low, high = X.fit_edits(a, b)
        assert n == edits(a.tolist(), b.tolist()) and edits(a.tolist(), b[low:high].tolist()) == n


def test_planted_leaks(spark):
    random.seed(4)
    vocabulary = [f"v{i}" for i in range(500)]
    prose = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [prose(n) for n in (8, 15, 16, 30, 64, 200)]
    docs, planted = [], set()
    for k in range(120):
        text = prose(random.randrange(0, 300))
        if k < 60:
            item = list(items[k % 6])
            for _ in range(int(0.1 * len(item)) if k % 2 else 0):
                item[random.randrange(len(item))] = "changed"
            at = random.randrange(len(text) + 1)
            text = text[:at] + [x.upper() for x in item] + text[at:]
            planted.add((k, k % 6))
        docs.append((k, ", ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, " ".join(items[3]), "x")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, edits string")
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "v1 v2")]
    bench = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in X.find_leaks(docs, bench).collect()}
    assert got - {(None, 3)} <= planted and (None, 3) in got
    assert len(got & planted) >= 0.98 * len(planted)
    assert X.find_leaks(docs.limit(0), bench).count() == 0
    assert X.find_leaks(docs, bench.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, X.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(X, "BLOCK_KEYS", 2000)
    assert one and sorted(map(tuple, X.find_leaks(docs, bench).collect())) == one


def test_every_exact_leak_is_found(spark):
    docs, bench = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r["doc_id"], X.item_words([r["text"]])[0].tolist()) for r in docs.collect()]
    want = set()
    for r in bench.collect():
        x = X.item_words([r["text"]])[0].tolist()
        for k, t in texts:
            if x[0] in t and any(t[i : i + len(x)] == x for i in range(len(t) - len(x) + 1)):
                want.add((k, r["item_id"]))
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in X.find_leaks(docs, bench).collect()}


def edited(item, n, rng):
    """The item after ``n`` random insertions, deletions and changes."""
    out = list(item)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = [] if kind == 2 and len(out) > 1 else [f"new{rng.randrange(10**6)}"]
    return out


def test_recall_of_every_size_and_share_of_edits(spark):
    rng = random.Random(8)
    prose = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items, docs, planted = [], [], set()
    for size in (8, 15, 16, 32, 64, 128, 256, 500):
        for share in (10, 15, 20):
            for _ in range(4):
                item, n = prose(size), size * share // 100
                docs.append((len(items), " ".join(prose(rng.randrange(60)) + edited(item, n, rng) + prose(rng.randrange(60)))))
                # changes only, at even distances
                spread = list(item)
                for i in range(n):
                    spread[(2 * i + 1) * size // (2 * n)] = f"gone{i}"
                docs.append((1000 + len(items), " ".join(spread)))
                planted |= {(len(items), len(items)), (1000 + len(items), len(items))}
                items.append((len(items), " ".join(item)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in X.find_leaks(docs, bench).collect()} == planted


def test_short_items_against_the_plain_table(spark):
    rng = random.Random(9)
    prose = lambda n: [f"v{rng.randrange(9)}" for _ in range(n)]
    items = [prose(1 + k % 12) for k in range(36)]
    docs = [prose(rng.randrange(25)) for _ in range(40)]
    want = {(d, i): edits(x, y) for d, y in enumerate(docs) for i, x in enumerate(items)}
    want = {k: n for k, n in want.items() if n <= len(items[k[1]]) // 5}
    table = spark.createDataFrame([(d, " ".join(y)) for d, y in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {}
    for r in X.find_leaks(table, bench).collect():
        key, place = (r["doc_id"], r["item_id"]), docs[r["doc_id"]][r["start_word"] : r["end_word"]]
        assert edits(items[key[1]], place) == r["edits"]
        got[key] = min(r["edits"], got.get(key, 99))
    assert any(len(items[i]) < 8 for _, i in want) and got == want


def test_copies_side_by_side_are_each_found(spark):
    docs = spark.createDataFrame([(1, "a a b c d e f a c d e f a b c d e f")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "a")], "item_id bigint, text string")
    got = sorted((r["item_id"], r["start_word"], r["end_word"], r["edits"]) for r in X.find_leaks(docs, bench).collect())
    assert got == [(1, 1, 7, 0), (1, 7, 12, 1), (1, 12, 18, 0), (2, 0, 1, 0), (2, 1, 2, 0), (2, 7, 8, 0), (2, 12, 13, 0)]
