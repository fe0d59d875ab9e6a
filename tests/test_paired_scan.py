"""Two-line histograms paired while files are read, over span borders and in packed files."""

import gzip
import random
from collections import Counter

import pytest
import zstandard

from metricloom.sources import captures
from metricloom.streaming.jobs import settings

HEADER, OWNER = "!M 1700000000 #2 1 3.5 2 4.5", "m.one source=a k=v"


def brute(lines):
    out, i = [], 0
    while i < len(lines):
        if lines[i].startswith("!") and i + 1 < len(lines) and lines[i + 1].startswith("m."):
            out.append(lines[i] + "\n" + lines[i + 1])
            i += 1
        else:
            out.append(lines[i])
        i += 1
    return out


def some_lines(seed, n):
    random.seed(seed)
    kinds = [HEADER, HEADER, "m.one source=a k=" + "v" * 9, "cpu 1.5 1700000000 source=b", "", "# note", "!M 5 #1 2 3 m.inline source=a"]
    return [random.choice(kinds) + ("" if i % 7 else " ") for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "gzip", "zstd"])
def test_files_of_every_kind(spark, tmp_path, kind):
    want = Counter()
    for k in range(3):
        lines = some_lines(k, 400) + [HEADER] * (k == 1)
        want.update(brute(lines))
        data = "".join(x + "\n" for x in lines).encode()
        folder = tmp_path / "dt=2024-01-01" / "mig=a" / "i-1"
        folder.mkdir(parents=True, exist_ok=True)
        name = {"plain": "part-%d.wf", "gzip": "part-%d.wf.gz", "zstd": "part-%d.wf.zst"}[kind] % k
        packed = {"plain": lambda x: x, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[kind](data)
        (folder / name).write_bytes(packed)
    got = Counter(r["value"] for r in captures.scan_paired_lines(spark, str(tmp_path)).collect())
    assert got == want


def test_pairs_over_span_borders(spark, tmp_path):
    lines = some_lines(9, 3000) + [HEADER, OWNER] * 400 + ["x" * 5000] + [HEADER, "m.two source=c", HEADER]
    (tmp_path / "big.wf").write_text("".join(x + "\n" for x in lines))
    (tmp_path / "small.wf").write_text(HEADER + "\n" + OWNER + "\n" + HEADER + "\n")
    want = Counter(brute(lines)) + Counter([HEADER + "\n" + OWNER, HEADER])
    for span in (300, 997, 1024, 1 << 20):
        small = {"spark.sql.files.maxPartitionBytes": str(span), "spark.sql.files.openCostInBytes": "64"}
        with settings(spark, small | {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}):
            rows = captures.scan_paired_lines(spark, str(tmp_path))
            assert Counter(r["value"] for r in rows.collect()) == want
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "edge" in plan[plan.index("Exchange") :]


def test_no_files_no_lines(spark, tmp_path):
    (tmp_path / "empty.wf").write_text("")
    assert captures.scan_paired_lines(spark, str(tmp_path)).collect() == []
