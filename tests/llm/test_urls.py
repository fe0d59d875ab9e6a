import re

from metricloom.llm import url_filter as U
from metricloom.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def own_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def run(spark, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    df = df.selectExpr("*", "'old' AS verdict", "1 AS host")
    out = U.filter_urls(df, spark.createDataFrame(URL_RULES, RULES))
    return out, {r["page_id"]: r for r in out.collect()}


def test_own_rules(spark):
    urls = [
        None, "", "no scheme.com/", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "x://example.com/en", "http://com/",
        "http://com", "http://xcom/", "ftp://a.b.net/fr/1", "http://net/fr/", "http://net?x=/fr/", "http://É.net/es/#://com/", "a://b://c.com/",
        "http://www.example.com/EN/", "http://a.com/\nx", "http://a.b.net/fr/1",
    ]
    out, got = run(spark, [(u, None) for u in urls])
    for i, u in enumerate(urls):
        host, path, rule, verdict = own_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow"), u
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_aliases(spark):
    link = '<head><LINK href="{}" rel=canonical></head>'
    turn = '<meta http-equiv="refresh" content="0; URL={}">'
    pages = [
        ("http://a.org/1", link.format("http://x.example.com/en/1")),  # alias of a blocked page
        ("https://www.a.org/1.html?utm_source=z#t", None),  # same page as the first
        ("http://b.org/1", turn.format("/2")),
        ("http://b.org/2/", link.format("//a.org/1")),  # chain
        ("http://www.example.com/en/9", link.format("http://x.example.com/en/9")),  # explicitly allowed
        ("http://c.org/9", link.format("http://x.example.com/en/9")),  # allowed alias goes first
        ("http://d.org/", "<p>nothing"),
        ("http://a.org/1?page=2", None),  # another page
        ("http://e.org/dir/x", link.format("y&amp;z")),
    ]
    _, got = run(spark, pages)
    assert [got[i]["verdict"] for i in range(len(pages))] == ["block"] * 4 + ["allow"] * 5
    assert got[8]["component"] is not None


def test_empty(spark):
    out, got = run(spark, [])
    assert got == {} and "verdict" in out.columns
    df = spark.createDataFrame([(1, "http://net/fr/", None)], "page_id bigint, url string, html string")
    assert U.filter_urls(df, spark.createDataFrame([], RULES)).first()["verdict"] == "allow"
