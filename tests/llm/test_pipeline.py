import corpus_pipeline as P
from brute import near_duplicates, repeats
from metricloom.llm import decontaminate

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    steps = dict(P.STAGES)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "12 + 34 = ?"), (10**6 + 2, "")], "doc_id bigint, text string")
    marked = docs.unionByName(extra, allowMissingColumns=True)
    known = steps["language_id"](spark, marked, D)
    assert known.columns == docs.columns
    ids = {r["doc_id"] for r in known.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}

    kept = steps["minhash_dedup"](spark, docs, D)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {c for _, _, c in near_duplicates(list(texts.items()), P.SHINGLE)}
    assert {r["doc_id"] for r in kept.collect()} == want

    twice = steps["minhash_dedup"](spark, docs.union(docs.where("doc_id < 50")), D)
    assert sorted(r["doc_id"] for r in twice.select("doc_id").collect()) == sorted(want)

    cut = steps["substring_dedup"](spark, docs, D).collect()
    whole = dict(zip(texts, repeats(texts.values(), P.PASSAGE)))
    assert all(" ".join(r["text"].split()) == " ".join(whole[r["doc_id"]][2].split()) for r in cut)
    assert all(r["text"] == texts[r["doc_id"]] for r in cut if not whole[r["doc_id"]][1])

    leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    clean = {r["doc_id"] for r in steps["decontamination"](spark, docs, D).collect()}
    assert leaks and clean == set(texts) - leaks


def test_run_and_empty_table(spark, tmp_path):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "target", "taken", "repeats"} <= set(out.columns)
    assert out.where("repeats < 1 OR taken > 3 * size").count() == 0 < out.count()
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0
