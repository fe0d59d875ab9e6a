import random

from brute import groups
from metricloom.llm.components import components


def check(spark, links):
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == groups({x for p in real for x in p}, real)


def test_chain_star_and_random(spark):
    random.seed(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 180)]
    noise = [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(90)]
    check(spark, chain + star + noise + [(5, 5), (None, 3), (7, None), (1, 0), (1, 0)])


def test_no_links(spark):
    check(spark, [])
