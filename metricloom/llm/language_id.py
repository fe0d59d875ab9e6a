"""Language identification with bit-sliced Bloom filters of letter n-grams.

One table of bit positions serves all languages: each position holds a mask with one bit per
language, so ANDing the masks at an n-gram's positions gives every language that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.words import fresh

c = F.col
UNKNOWN = "und"
N = 3  # letters of an n-gram, word borders included
HASHES = 3
POSITIONS_LOG2 = 18  # bit positions; with 64 languages the model has 2 MiB at any corpus size
MAX_LANGUAGES = 64
SAMPLE_ROWS = 3000  # labelled rows per language that the fit looks at, about
SAMPLE_CHARS = 1 << 22  # letters hashed at once
MIN_SHARE = 1e-4  # of a language's n-grams; rarer ones are not its own
MIN_RATIO = 0.25  # of the n-gram's share in the language where it is most common

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of the n-grams around each letter of the lower-cased text, in bounded pieces."""
    for at in range(0, max(len(text), 1), SAMPLE_CHARS):
        piece = text[max(at - 1, 0) : at + SAMPLE_CHARS + 1].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[codes]
        if not letter.any():
            continue
        padded = np.full(len(codes) + 2, 32, np.uint64)
        padded[1:-1] = np.where(letter, codes, 32)
        middle = np.flatnonzero(letter) + 1
        middle = middle[(middle > (at > 0)) & (middle <= len(codes) - (at + SAMPLE_CHARS < len(text)))]
        yield padded[middle - 1] << np.uint64(42) | padded[middle] << np.uint64(21) | padded[middle + 1]


def positions(codes: np.ndarray) -> list[np.ndarray]:
    """Bit positions of n-gram codes, one array per hash function."""
    x = codes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << POSITIONS_LOG2) - 1)
    return [(x >> np.uint64(k * 21)) & mask for k in range(HASHES)]


@dataclass
class Model:
    """Bit-sliced filters. ``table[p]`` has bit l when language l has an n-gram at position p."""

    languages: list[str]
    table: np.ndarray

    def __post_init__(self):
        fill = [float(np.mean((self.table >> np.uint64(k)) & np.uint64(1))) for k in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams found per language, and all n-grams."""
        found, total = np.zeros(len(self.languages)), 0
        for codes in grams(text):
            at = positions(codes)
            mask = self.table[at[0]]
            for p in at[1:]:
                mask &= self.table[p]
            total += len(codes)
            for k in range(len(self.languages)):
                found[k] += np.count_nonzero(mask & np.uint64(1 << k))
        return found, total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its part of all languages' corrected counts, and the share of n-grams it has."""
        found, total = self.hits(text or "")
        if not total or not self.languages:
            return UNKNOWN, 0.0, 0.0
        real = np.clip((found - total * self.false_rate) / (1 - self.false_rate), 0, total)
        best = int(np.argmax(real))
        whole = real.sum()
        return self.languages[best], float(real[best] / whole) if whole else 0.0, float(real[best] / total)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n), counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(lang, []).extend(grams(text))
            for lang, parts in sums.items():
                if parts:
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    parts = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn the filters from labelled rows; rows without label or text are passed over.

    Of each language about ``sample_rows`` rows are looked at, chosen by a hash of their key. An
    n-gram belongs to a language when it has at least ``MIN_SHARE`` of that language's n-grams and
    ``MIN_RATIO`` of its share in the language where it is commonest, so loan words and wrong
    labels drop out. Bits are set in the cluster; at most one row per bit position reaches the
    driver. Without any labelled row the model knows no language.
    """
    labelled = labelled.select(c(key).alias("key"), c(lang).alias("lang"), c(text).alias("text")).where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in counts]
    table = np.zeros(1 << POSITIONS_LOG2, np.uint64)
    if not languages:
        return Model([], table)
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample_rows / r["count"]))])
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) / float(1 << 20)
    n = gram_counts(labelled.where(draw < part[c("lang")]))
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    share = n.join(total, "lang").withColumn("share", c("n") / c("total"))
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    own = share.where(c("share") >= MIN_SHARE).join(top, "gram").where(c("share") >= c("top") * MIN_RATIO)
    bit = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mask = np.int64(1) << batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate(positions(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(mask, HASHES))], ["at", "mask"])

    bits = own.select("gram", bit[c("lang")].alias("bit")).mapInArrow(place, "at bigint, mask bigint")
    for row in bits.groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():
        table[row["at"]] = np.array(row["mask"], np.int64).view(np.uint64)
    return Model(languages, table)


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score, share) of each whole text; ``und`` with 0 where it is null or has no letter.

    ``score`` is the winner's part of all languages' corrected counts, ``share`` the part of the
    text's n-grams that the winner has.
    """

    @F.arrow_udf("struct<lang string, score double, share double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.predict(x.as_py()) for x in texts]
            lang, score, share = zip(*found) if found else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], ["lang", "score", "share"]
            )

    return run(text)


def held_out(key: Column, rest: int = 2, parts: int = 4) -> Column:
    """Rows kept away from training."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == rest


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_share``; map-only, one row for each row.

    Existing columns of the three names are replaced; repeated rows and ties between languages
    (the first in order wins) give the same result each time; an empty table stays empty.
    """
    docs = docs.drop(*[x for x in ("lang_pred", "score", "lang_share") if x != text])
    (found,) = fresh(docs.columns, "_lang")
    out = docs.withColumn(found, predict(c(text), model))
    return out.select(
        *[c(f"`{x}`") for x in docs.columns],
        c(found)["lang"].alias("lang_pred"), c(found)["score"].alias("score"), c(found)["share"].alias("lang_share"),
    )
