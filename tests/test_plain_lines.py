"""The short way for plain metric lines gives what the long way gives."""

import random

from metricloom.functions.lines import FAST, PLAIN, _plain_points, parse_lines
from pyspark.sql import functions as F

PARTS = [
    "cpu.load", "∆hits", "Δhits", '"∆quoted.name"', "-bad", "a_b-c.d", "5xx", "1.5", "-2", "+.5e3", "1e999", "NaN", "1.", "1700000000", "170000000", "17000000001",
    "source=a", "source=b", "host=h", "source=", "source==x", "env=prod", "env=dev", "k=a=b", 'k="a b"', 'k="a\\"b"', "k=a\\b", "k=a\"b", "path/x.y=1", "é=1", "k=é", "k", "=v",
    "#5", "!M", "!M 1 #2", "put", "sourceX=1", "x.source=2", "1.5 1700000000", "\\t",
]
BLANKS = [" ", " ", " ", "  ", "\t", " \x0b", "　", "\n"]


def some_lines():
    random.seed(11)
    yield from ["cpu 1 source=a", "cpu 1 1700000000 source=a", "cpu 1 host=a", "cpu 1 source=a host=b", "cpu 1 host=b source=a x=1", "cpu 1 1700000000", "cpu 1", "cpu", " cpu 1 source=a ", "\tcpu 1 source=a"]
    yield "wide 1 source=a " + " ".join(f"k{i}=v{i}" for i in range(3000))
    yield "long 1 source=" + "x" * 200_000
    good = ["env=prod", "env=dev", "k=a=b", "host=h", "path/x.y=1", "k=é", "sourceX=1", "x.source=2", "source=z"]
    for _ in range(3000):
        head = [random.choice(["cpu.load", "∆hits", "a_b-c.d", "5xx"]), random.choice(["1.5", "-2", "+.5e3", "1."])] + random.choice([[], ["1700000000"]])
        yield random.choice([" ", "  ", "\t"]).join(head + random.sample(["source=a", *good], random.randrange(1, 5)))
    for _ in range(6000):
        line = random.choice(PARTS[:8]) + random.choice(BLANKS) + random.choice(PARTS[7:17])
        for _ in range(random.randrange(5)):
            line += random.choice(BLANKS) + random.choice(PARTS)
        yield line


def test_both_ways_agree(spark):
    rows = [(i, x) for i, x in enumerate(some_lines())]
    df = spark.createDataFrame(rows, "odd_id bigint, value string")
    fields = lambda d: {r["odd_id"]: r.asDict(recursive=True) for r in d.collect()}
    fast, slow = fields(parse_lines(df)), fields(parse_lines(df, plain=False))
    assert fast.keys() == slow.keys()
    for k in slow:
        assert fast[k] == slow[k], rows[k][1][:200]
    taken = _plain_points(df.select("odd_id", F.trim("value").alias("_line")), ["odd_id"]).where(F.col(FAST).isNotNull()).count()
    good = sum(r["record_type"] == "metric" for r in slow.values())
    assert 500 < taken <= good


def test_pattern_has_no_quotes():
    assert "\\\\" in PLAIN and '"' in PLAIN


SPANS = [
    "op source=a 1700000000000 12", "op.x source=a k=v 1 0.5", "∆op host=a k=a=b 12 3e2", "op  source=a\tk=v 1 2", "op source=a 1 1e999", "op source=a 1 1e16",
    "op source=a k=1 k=2 1 2", "op k=v 1 2", 'op source="a b" 1 2', "op source=a 1 -2.7", "op source=a 1x 2", "op source=a 2", "op source=a 99999999999999999999 2",
    "op source=a 1 2\n", "op source=a 1 2 3", "op source=a k=\x01 1 2", "op source=a 1 2\u0085", "op 5=1 source=a 1 2", "op source=a host=b 1 2", "op source=a",
    "cpu 1 source=a k=\x01", "cpu\x01 1 source=a", "\x01\x01\x01\x01\x01", "span\x01op\x011\x012\x01source=a", "cpu 1 1700000000 source=a\n", "cpu 1 source=a k= source=b",
]


def test_plain_spans_agree_both_ways(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(SPANS)], "odd_id bigint, value string")
    fields = lambda d: {r["odd_id"]: r.asDict(recursive=True) for r in d.collect()}
    fast, slow = fields(parse_lines(df)), fields(parse_lines(df, plain=False))
    for i, x in enumerate(SPANS):
        assert fast.get(i) == slow.get(i), x
    short = _plain_points(df.select("odd_id", F.trim("value").alias("_line")), ["odd_id"]).where(F.col(FAST).isNotNull())
    assert {0, 1, 2, 9} <= {r["odd_id"] for r in short.collect()}
