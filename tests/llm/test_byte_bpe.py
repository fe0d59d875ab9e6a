import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from metricloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = (
    ["'", "'s", "'ll", "'re", "'ve", "'m", "'d", "'t", "'S", "s", "l", "r", "e", "ll", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\u0085", "　"]
    + ["abc", "Ünder", "日本語", "12", "²", "Ⅷ", "½", "٣", ".", "!?", "_", "<|endoftext|>", "é", "é", "😀", "\U0001f468‍\U0001f469", "\x00", "\x1c", "​", "﻿", "᠎", "the", " the"]
)


def samples():
    random.seed(3)
    yield from ["", " ", "  ", "'", "''s", "!'s", " 's", "  's", "\n's", "x's's'sx", "'ll'l", "x'l", "x'r e", "a  b", "a \n b", "a\n\n", "   ", "1's 2'll", "a" * 300, " " * 99 + "x", "ab" * 500, "  x", "  x", "x  "]
    for _ in range(1500):
        yield "".join(random.choice(PARTS) for _ in range(random.randrange(1, 40)))


def test_ids_equal_the_library(plain):
    codec, texts = B.Codec(PATH), list(samples())
    raw = [t.encode() for t in texts]
    at = np.append(0, np.cumsum([len(x) for x in raw]))
    ids, first = codec.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == plain.encode_ordinary(text), repr(text)
        assert codec.decode(ids[first[k] : first[k + 1]]).tobytes() == raw[k]


def test_every_code_point(plain):
    codec = B.Codec(PATH)
    points = [chr(x) for x in range(0x3500) if not 0xD800 <= x < 0xE000] + [chr(x) for x in range(0xA000, 0x30000, 37) if not 0xD800 <= x < 0xE000]
    text = "".join(f"a{x}{x} {x}1" for x in points)
    data = np.frombuffer(text.encode(), np.uint8)
    assert codec.encode(data, np.array([0, len(data)]), 1 << 30)[0].tolist() == plain.encode_ordinary(text)


def test_long_texts_in_windows(plain):
    codec = B.Codec(PATH)
    random.seed(5)
    text = "".join(random.choice(PARTS) for _ in range(3000)) + "x" * 500 + " " * 400 + "y" + "don't we'll " * 50
    data = np.frombuffer(text.encode(), np.uint8)
    want = plain.encode_ordinary(text)
    for size in (13, 40, 101, 1000):
        assert codec.encode(data, np.array([0, len(data)]), size)[0].tolist() == want


def test_long_pieces(plain):
    random.seed(7)
    codec = B.Codec(PATH)
    for piece in ("a" * 5000, "ab" * 999, "".join(random.choice("abcde") for _ in range(3000)), "é" * 700):
        assert B.merge(piece.encode(), codec.ranks) == plain.encode_ordinary(piece)


def test_columns(spark, plain):
    rows = [(1, None), (2, ""), (3, "it's here, isn't it?"), (3, "it's here, isn't it?"), (None, "日本 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS IDS", "1 AS `odd.name`")
    out = B.encode(docs)
    assert out.columns == ["doc_id", "text", "odd.name", "ids", "token_ends"]
    back = B.decode(out.withColumn("same", F.col("ids")))
    got = {r["doc_id"]: r.asDict() | {"ids": r["same"]} for r in back.collect()}
    assert (bytes(got[1]["decoded"]), got[1]["ids"], got[2]["ids"]) == (b"", [], [])
    assert got[3]["ids"] == plain.encode_ordinary(rows[2][1]) and bytes(got[3]["decoded"]).decode() == rows[2][1]
    assert out.count() == 5 and B.encode(docs.limit(0)).count() == 0
    long = out.where("doc_id is null").first()
    assert long["ids"] == plain.encode_ordinary(rows[4][1]) and long["token_ends"][-1] == len(rows[4][1].encode())
    some = out.where("doc_id = 3").select(B.token_bytes(F.col("text"), F.col("token_ends"), F.lit(1), F.lit(2)).alias("b")).first()["b"]
    assert bytes(some) == plain.decode_bytes(got[3]["ids"][1:3])
    odd = spark.createDataFrame([([1, None],), ([-1],), ([99999],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in B.decode(odd).collect()] == [None, None, None, None, b""]
