"""Stateful stream operators over several runs on one checkpoint, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from metricloom.operators import divergence as V
from metricloom.session import work_dir
from metricloom.streaming import jobs, stateful


def in_steps(spark, schema, steps, build):
    """Feed ``steps`` one run at a time, each a restart; returns the table and every run's progress."""
    path, out, checkpoint = (work_dir(spark, x) for x in ("steps", "out", "checkpoint"))
    seen = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/step={k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
        table, progress = jobs.run_to_table(build(stream), "steps", state=jobs.ROCKSDB, path=out, checkpoint=checkpoint)
        seen.append(progress)
    return table, seen


POINT = "family_id string, ts bigint, source string, value double, line_length bigint, tags map<string,string>"


def test_panes_make_windows_and_stay_few(spark, monkeypatch):
    monkeypatch.setattr(stateful, "PIECE", 3)
    minutes = [[t0 + m * 60 + s for m in range(10) for s in (0, 7, 30)] for t0 in (60000, 60600, 61200)]
    row = lambda ts: ("f", ts, f"h{ts % 11}", float(ts % 3), ts % 5, {"k": str(ts % 2)})
    steps = [[row(ts) for ts in part] for part in minutes] + [[row(64000)], [row(69000)]]
    table, seen = in_steps(spark, POINT, steps, lambda s: stateful.pane_counts(s, 300, 60, "0 seconds", ways=2))
    want = Counter()
    for part in minutes:
        for ts in part:
            _, _, source, value, size, tags = row(ts)
            for dim, name in (("source", source), ("value", str(value)), ("size", str(size)), ("tag:k", tags["k"])):
                for start in range(ts // 60 * 60 - 240, ts // 60 * 60 + 1, 60):
                    want["f", start, dim, name] += 1
    got = Counter({(r["family_id"], r["window_start"], r["dim"], r["value"]): r["n"] for r in table.where("window_start < 63000").collect()})
    assert got == want
    held = [max(int(p["stateOperators"][0]["numRowsTotal"]) for p in run if p["stateOperators"]) for run in seen]
    after = [int(run[-1]["stateOperators"][0]["numRowsTotal"]) for run in seen]
    # three tenths of an hour pass, but only the panes of open windows and one timer per key remain
    assert after[2] <= after[0] * 1.5 and after[4] <= 3 * 4 * 2 and max(held) < 500
    assert not any(jobs.dropped_late(run) for run in seen)


def test_state_follows_counts_not_panes(spark):
    rows = [("f", 60000 + 60 * m, "h", 1.0, 5, {"k": "x"}) for m in range(400)] + [("f", 60000, None, 1.0, 5, {})]
    steps = [rows, [("f", 60000 + 60 * 401, "h", 1.0, 5, {})], [("f", 10**6, "h", 1.0, 5, {})]]
    table, seen = in_steps(spark, POINT, steps, lambda s: stateful.pane_counts(s, 300, 60, "0 seconds", ways=1, numbers=False))
    got = Counter({(r["window_start"], r["dim"], r["value"]): r["n"] for r in table.where("window_start < 90000").collect()})
    want = Counter()
    for _, ts, source, _, _, tags in [*rows, *steps[1]]:
        for start in range(ts - 240, ts + 1, 60):
            for dim, name in (("source", source), *((f"tag:{k}", v) for k, v in tags.items())):
                want[start, dim, name] += 1
    assert got == want
    # 400 minutes of two dimensions: a piece, a timer and little else each
    assert max(int(p["stateOperators"][0]["numRowsTotal"]) for run in seen for p in run if p["stateOperators"]) < 20


def test_windows_need_whole_steps():
    with pytest.raises(ValueError):
        stateful.Panes(300, 70)


def test_newest_rows_over_restarts(spark):
    rows = [(f"f{i % 2}", i * 37 % 101, i, None if i % 7 == 0 else f"n{i}") for i in range(200)]
    steps = [rows[0:90], rows[90:100], rows[100:101], rows[101:200]]
    schema = "family_id string, ts bigint, row_id bigint, note string"
    table, _ = in_steps(spark, schema, steps, lambda s: stateful.newest_rows(s, ["family_id"], ["ts", "row_id"], 12, ways=2))
    got = stateful.latest_rows(table, ["family_id"], ["ts", "row_id"], 12).collect()
    for f in ("f0", "f1"):
        want = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1], r[2]), reverse=True)[:12]
        mine = sorted((r for r in got if r["family_id"] == f), key=lambda r: r["rank"])
        assert [(r["ts"], r["row_id"], r["note"]) for r in mine] == [(r[1], r[2], r[3]) for r in want]


def test_late_rows_are_kept(spark):
    steps = [[("a", 1000, {"k": "1"})], [("a", 3000, {})], [("b", 900, {"k": "2"}), ("b", 900, {"k": "2"}), ("b", 2950, None)]]
    table, seen = in_steps(spark, "name string, ts bigint, tags map<string,string>", steps, lambda s: stateful.split_late(s, "100 seconds"))
    got = sorted((r["name"], r["ts"], r["late"], r["delay"]) for r in table.collect())
    assert got == [("a", 1000, False, 0), ("a", 3000, False, 0), ("b", 900, True, 2000), ("b", 900, True, 2000), ("b", 2950, False, 0)]
    assert not any(jobs.dropped_late(run) for run in seen)
    assert table.where("name = 'b' AND ts = 900").first()["tags"] == {"k": "2"}


def test_silent_family_is_evaluated_by_timer(spark):
    day = 10
    busy = lambda n: [("busy", k * day, "red") for k in n]
    steps = [
        busy(range(3)) + [("silent", 0, "red"), ("silent", 10, "red"), ("gap", 0, "red"), ("gap", 20, "red")],
        busy(range(3, 6)),
        busy(range(6, 8)) + [("gap", 10, "red")],
        [("busy", 300, "green")],
        [("busy", 400, "green"), ("silent", 400, "red")],
    ]
    table, _ = in_steps(spark, "family_id string, window_start bigint, status string", steps, lambda s: stateful.evaluations(s, day, day, retire=3))
    got = {}
    for r in table.orderBy("window_start").collect():
        if not r["late"]:
            got.setdefault(r["family_id"], []).append((r["window_start"], r["status"], r["red_streak"]))
    gone = V.INSUFFICIENT
    assert got["silent"] == [(0, "red", 1), (10, "red", 2), (20, gone, 0), (30, gone, 0), (40, gone, 0), (400, "red", 1)]
    assert got["gap"] == [(0, "red", 1), (10, gone, 0), (20, "red", 1), (30, gone, 0), (40, gone, 0), (50, gone, 0)]
    assert got["busy"][:8] == [(k * day, "red", k + 1) for k in range(8)] and got["busy"][8][1] == gone
    assert [r["family_id"] for r in table.where("late").collect()] == ["gap"]
    scored = spark.createDataFrame([r for s in steps for r in s if r[:2] != ("gap", 10)], "family_id string, window_start bigint, status string")
    filled = V.red_streaks(V.fill_silent(scored, ["family_id"], "window_start", day, 3), ["family_id"], "window_start")
    batch = {}
    for r in filled.orderBy("window_start").collect():
        batch.setdefault(r["family_id"], []).append((r["window_start"], r["status"], r["red_streak"]))
    assert {k: v for k, v in batch.items() if k == "gap"} == {"gap": got["gap"]} and batch["silent"][:6] == got["silent"][:6]


def test_window_scores_equal_family_scores(spark):
    ref = spark.createDataFrame(
        [("f", "source", "a", 3), ("f", "source", "b", 1), ("f", "tag:k", "x", 4), ("f", "tag:z", "y", 2), ("g", "source", "a", 1)],
        "family_id string, dim string, value string, n bigint",
    )
    cur = [("f", "source", "a", 1), ("f", "source", "c", 2), ("f", "tag:k", "x", 3), ("f", "tag:new", "x", 1), ("h", "source", "q", 5)]
    cur = spark.createDataFrame(cur, "family_id string, dim string, value string, n bigint")
    a = {r["family_id"]: r for r in V.js_scores(ref, cur, ["family_id"]).collect()}
    b = {r["family_id"]: r for r in V.js_windows(ref, cur, ["family_id"], ["family_id"]).collect()}
    for f in ("f", "h"):
        for x in ("js_source", "js_tags_avg", "js_categorical"):
            assert b[f][x] == pytest.approx(a[f][x], abs=1e-12)


def test_silent_families_stay_in_the_report(spark):
    dims = "family_id string, dim string, value string, n bigint"
    q = "family_id string, p01 double, p05 double, p50 double, p95 double, p99 double"
    five = [1.0, 2.0, 3.0, 4.0, 5.0]
    ref = {"dims": spark.createDataFrame([("on", "source", "a", 50), ("off", "source", "a", 50)], dims), "value_q": spark.createDataFrame([("on", *five), ("off", *five)], q)}
    ref["size_q"] = ref["value_q"]
    cur = {"dims": spark.createDataFrame([("on", "source", "a", 20), ("few", "source", "a", 3)], dims), "value_q": spark.createDataFrame([("on", *five), ("few", *five)], q)}
    cur["sizes"] = spark.createDataFrame([("on", 3, 20), ("few", 3, 3)], "family_id string, line_length bigint, n bigint")
    got = {r["family_id"]: (r["n"], r["status"], r["js_source"]) for r in V.score(ref, cur, ["family_id"], silent=True).collect()}
    assert got["off"] == (0, V.INSUFFICIENT, None) and got["few"] == (3, V.INSUFFICIENT, None) and got["on"][:2] == (20, "red")
    assert {r["family_id"] for r in V.score(ref, cur, ["family_id"]).collect()} == {"on"}


def test_correlation_far_from_zero(spark):
    base = 10**9
    rows = [("f", m, base + m % 3, base + (m % 3) * 2) for m in range(1440)] + [("flat", m, base, base + m) for m in range(1440)]
    df = spark.createDataFrame(rows, "family_id string, mod bigint, x bigint, y bigint")
    ref, cur = (df.select("family_id", "mod", F.col(x).alias("n")) for x in "xy")
    got = {r["family_id"]: r["temporal_corr"] for r in V.curve_correlation(ref, cur, ["family_id"]).collect()}
    assert got["f"] == pytest.approx(1.0, abs=1e-9) and got["flat"] is None
