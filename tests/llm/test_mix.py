import random

from metricloom.llm import mixing as M


def targets(sizes):
    """Repeated sharing, by hand."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: rate * weight[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return out


def test_targets_and_sizes(spark):
    random.seed(6)
    rows = [(i, random.choice(["a", "b", "c", "d", "é", None, "n", "sn"]), random.choice([0, 1, 5, 40, 900])) for i in range(3000)]
    rows += [(5000 + i, "tiny", 3) for i in range(2)] + [(6000, "none", 0), (None, "a", 7), (None, "a", 9), (7000, "big", 10**6), (7001, "big", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").selectExpr("*", "'x' AS edge", "'y' AS taken")
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + (r["size"] or 0)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"] or 0)
        assert 0 <= r["repeats"] <= 3 and r["taken"] == r["repeats"] * (r["size"] or 0) and r["edge"] == "x"
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 16) / 2 + 1e-6, s
    again = {(r["doc_id"], r["size"], r["source"]): r["taken"] for r in M.mix_sources(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], r["source"]): r["taken"] for r in got}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, size bigint")
    assert M.mix_sources(df).count() == 0
    df = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id bigint, source string, size bigint")
    assert [r["taken"] for r in M.mix_sources(df).collect()] == [0, 0]
