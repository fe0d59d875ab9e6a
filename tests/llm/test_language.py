from pyspark.sql import functions as F

from metricloom.llm import language_id as L

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    out = L.identify(docs, model).where(L.held_out(F.col("doc_id"))).collect()
    assert model.languages == ["de", "en", "es", "fr"]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.99 * len(out) > 100
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edge_rows(spark):
    rows = [(1, "aaab aaab", "x"), (2, "ccd ccd", "y"), (3, None, "x"), (4, "zzz", None), (5, "12 34!", "y"), (5, "12 34!", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").withColumnRenamed("score", "lang")
    docs = docs.withColumn("lang_pred", F.lit("old")).withColumn("score", F.lit("old"))
    model = L.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and got[3] == got[5] == ("und", 0.0)
    assert L.identify(docs, model).count() == 6
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(docs.where("lang = 'none'"))
    assert [r["lang_pred"] for r in L.identify(docs, nothing).collect()] == ["und"] * 6


def test_long_text_in_pieces(monkeypatch):
    text = "Straße über Äpfel und the quick 12 brown fox " * 30
    whole = sorted(x for part in L.grams(text) for x in part.tolist())
    monkeypatch.setattr(L, "SAMPLE_CHARS", 17)
    assert sorted(x for part in L.grams(text) for x in part.tolist()) == whole
    assert len(whole) == sum(ch.isalpha() for ch in text)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "mine")], "doc_id bigint, text string, lang string, _LANG string")
    assert L.identify(docs, L.Model([], L.np.zeros(1 << L.POSITIONS_LOG2, "uint64"))).first()["_LANG"] == "mine"
