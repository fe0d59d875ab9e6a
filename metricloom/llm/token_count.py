"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20  # text handed to the encoder at once
LONG_CHARS = 1 << 15  # longer texts are split at safe places
BLANKS = (" ", "▁")  # the encoder writes a blank as its own mark


class Encoder:
    """A sentencepiece BPE model and the places where a text may be cut without changing its tokens.

    BPE joins neighbours only into pieces of the vocabulary. Where no piece holds two characters
    side by side, nothing is ever joined across them, so both sides are encoded as they would be in
    the whole text. A line break is no part of any piece; put before a later part, it takes the
    leading mark the encoder adds, and both are subtracted.
    """

    GUARD, GUARD_TOKENS = "\n", 2

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.joined = {a + b for p in pieces for a, b in zip(p, p[1:])}
        guard = self.model.encode(self.GUARD)
        self.can_split = len(guard) == self.GUARD_TOKENS and not any("\n" in pair for pair in self.joined)

    def safe(self, text: str, i: int) -> bool:
        """Whether the text may be cut before character ``i``."""
        pair = text[i - 1 : i + 1]
        for blank in BLANKS[:1]:
            pair = pair.replace(blank, BLANKS[1])
        return pair not in self.joined

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text, or guarded parts of ``size`` characters and as many more as a safe cut needs."""
        at = 0
        while self.can_split and len(text) - at > size:
            cut = at + size
            while cut < len(text) and not self.safe(text, cut):
                cut += 1
            if cut == len(text):
                break
            yield (self.GUARD if at else "") + text[at:cut]
            at = cut
        yield (self.GUARD if at else "") + text[at:]

    def lengths(self, texts: list[str], size: int = LONG_CHARS) -> list[int]:
        """Tokens of each text; batches of parts hold about the same number of characters."""
        out, batch, owners, load = [0] * len(texts), [], [], 0

        def flush():
            for k, ids in zip(owners, self.model.encode(batch, num_threads=1)):
                out[k] += len(ids)
            batch.clear(), owners.clear()

        for k, text in enumerate(texts):
            for n, part in enumerate(self.parts(text, size)):
                out[k] -= self.GUARD_TOKENS if n else 0
                batch.append(part)
                owners.append(k)
                load += len(part)
                if load >= BATCH_BYTES:
                    flush()
                    load = 0
        flush()
        return out


@cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


def token_lengths(text: Column, model: str | None = None, size: int = LONG_CHARS) -> Column:
    """Number of tokens of each whole text; null counts as empty, which has none.

    ``model`` is a path that every executor can read; without it the public 32k BPE vocabulary
    installed there is taken. No begin, end or added tokens; no truncation.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        enc = encoder(model or public_tokenizers.path("piece_bpe_32k.model"))
        for texts in batches:
            yield pd.Series(enc.lengths(texts.fillna("").tolist(), size), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, limit: int, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Row by row and map-only: repeated rows give repeated results, an empty table an empty one,
    null texts 0, False. Existing columns of the three names are replaced.
    """
    docs = docs.drop(*[x for x in ("n_bytes", "n_tokens", "over_limit") if x != text])
    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    out = out.withColumn("n_tokens", token_lengths(F.col(text), model))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
