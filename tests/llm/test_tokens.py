import random

import public_tokenizers
import sentencepiece

from metricloom.llm import token_count as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def samples():
    random.seed(1)
    parts = ["hello", " ", "  ", "\n", "\t", "▁", "é", "日本", "<s>", "</s>", "the", "ing", ".", "   x", "\u3000", "😀", "\x00", "aaaaaaaa", "12"]
    yield from ["", " ", "  ", "a", "a ", " a", "\n", "x" * 300, " " * 200, "▁ ▁", "ab" * 400]
    for _ in range(60):
        yield "".join(random.choice(parts) for _ in range(random.randrange(1, 120)))


def test_splitting_keeps_the_count():
    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = T.Encoder(MODEL)
    texts = list(samples())
    want = [len(x) for x in plain.encode(texts)]
    for size in (1, 7, 40, 10**6):
        assert enc.lengths(texts, size) == want
    assert max(len(p) for p in enc.parts("word " * 1000, 50)) < 100


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "tokens over limit"), (3, "tokens over limit")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS n_tokens")
    got = {r["doc_id"]: r for r in T.count_tokens(docs, 2).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"], got[1]["over_limit"]) == (0, 0, 0, False)
    assert got[3]["n_tokens"] > 2 and got[3]["over_limit"] and got[3]["n_bytes"] == 17
    assert T.count_tokens(docs.limit(0), 2).count() == 0
