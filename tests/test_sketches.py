"""Checksums from pieces and sketches from days, against one pass."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import sketches as S
from metricloom.streaming.jobs import settings


def test_known_checksum(spark):
    assert zlib.crc32(b"123456789") == 0xCBF43926
    rows = spark.createDataFrame([("123456789",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(F.crc32(F.encode("t", "UTF-8"))).collect()] == [0xCBF43926, 0, None]
    pieces = [b"1234", b"", b"5", b"6789"]
    behind = np.array([sum(map(len, pieces[i + 1 :])) for i in range(4)])
    assert np.bitwise_xor.reduce(S.carried(np.array([zlib.crc32(x) for x in pieces], np.uint32), behind)) == 0xCBF43926


def test_cut_at_many_places():
    random.seed(1)
    data = random.randbytes(100_000)
    for cuts in (1, 2, 17, 500):
        at = sorted(random.sample(range(len(data)), cuts)) + [len(data)]
        pieces = [data[a:b] for a, b in zip([0, *at], at)]
        crc = np.array([zlib.crc32(x) for x in pieces], np.uint32)
        behind = np.array([len(data) - b for b in at])
        assert int(np.bitwise_xor.reduce(S.carried(crc, behind))) == zlib.crc32(data)
    far = np.array([1 << 40, (1 << 33) + 12345])
    twice = S.carried(S.carried(np.array([7, 9], np.uint32), far), far)
    assert (twice == S.carried(np.array([7, 9], np.uint32), 2 * far)).all()


@pytest.mark.parametrize("span", [200, 4096, 1 << 20])
def test_files_in_spans(spark, tmp_path, span):
    random.seed(span)
    want = {}
    for k in range(3):
        text = "".join("".join(random.choice("abc é日") for _ in range(random.randrange(60))) + "\n" for _ in range(300 * k + 1))
        (tmp_path / f"f{k}.txt").write_text(text)
        want[f"f{k}.txt"] = (zlib.crc32(text.encode()), len(text.encode()))
    (tmp_path / "none.txt").write_text("")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(span), "spark.sql.files.openCostInBytes": "64"}):
        got = {r["file_path"].rsplit("/", 1)[-1]: (r["crc32"], r["bytes"]) for r in S.text_checksums(spark, str(tmp_path), "*.txt").collect()}
    assert got == want


def test_sketches_of_days_merge(spark):
    rows = spark.range(60000).select(F.lit("f").alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 60000).cast("double").alias("v"), (F.col("id") % 9000).cast("string").alias("s"))
    rows = rows.union(spark.createDataFrame([("f", 1, None, None), ("g", 1, None, None)], rows.schema))
    days = S.quantile_sketches(rows, ["k", "day"], "v")
    r = S.merge_quantiles(days, ["k"]).select("k", S.size(F.col("sketch")).alias("n"), S.quantile(F.col("sketch"), 0.5).alias("m"), F.octet_length("sketch").alias("b")).collect()
    assert len(r) == 1 and r[0]["n"] == 60000 and r[0]["b"] < 40000
    assert abs(r[0]["m"] - 30000) <= 2 * S.rank_error() * 60000
    est = S.merge_distinct(S.distinct_sketches(rows, ["k", "day"], "s"), ["k"]).select(S.distinct(F.col("sketch"))).collect()
    assert abs(est[0][0] - 9000) <= 4 * S.count_error() * 9000


def test_frequent_items_are_exact(spark):
    """A million different combinations in one family, a hundred common ones; a small family of ties."""
    n = 1_000_000
    rare = spark.range(n).select(F.lit("wide").alias("family_id"), F.concat(F.lit("r"), "id").alias("combo"))
    common = spark.range(100).select(F.lit("wide").alias("family_id"), F.concat(F.lit("c"), "id").alias("combo"), F.explode(F.sequence(F.lit(1), (F.col("id") + 1).cast("int") * 20)).alias("i")).drop("i")
    flat = spark.range(3000).select(F.lit("flat").alias("family_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("combo"))
    rows = rare.union(common.repartition(4)).union(flat).union(spark.createDataFrame([("flat", None)], "family_id string, combo string")).repartition(4)
    from metricloom.operators.counts import top_k, value_counts

    got = {(r["family_id"], r["rank"]): (r["combo"], r["n"]) for r in S.frequent_items(rows, ["family_id"], "combo", 50, 2000).collect()}
    want = {(r["family_id"], r["rank"]): (r["combo"], r["n"]) for r in top_k(value_counts(rows, ["family_id"], "combo"), ["family_id"], "combo", 50).collect()}
    assert got == want
    assert S.frequent_candidates(rows, ["family_id"], "combo", 2000).count() <= 4 * 2000
    assert S.frequent_items(rows.limit(0), ["family_id"], "combo", 50).count() == 0
