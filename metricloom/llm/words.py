"""Words of whole texts as numpy arrays: offsets, 64-bit word hashes and hashes of word runs.

Tasks see Arrow batches; :func:`slices` cuts them into row groups of bounded text bytes, so the
working arrays of a task stay small whatever the batch holds. A single longer text is hashed in
pieces cut at separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # text bytes worked on at once
PIECE_BYTES = 1 << 18  # longest stretch of one text hashed at once

SPACES = np.zeros(256, bool)  # the six ASCII white space bytes
SPACES[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
NON_ALNUM = np.ones(256, bool)  # every ASCII byte that is no letter or digit
NON_ALNUM[128:] = False
for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    NON_ALNUM[low:high] = False
LOWER = np.arange(256, dtype=np.uint8)  # A-Z to a-z, other bytes as they are
LOWER[0x41:0x5B] += 32

_random = np.random.default_rng(20)
BYTE_VALUES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE_BASE = 0x9E3779B97F4A7C15
RUN_BASE, RUN_BASE_2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def powers(b):
                out = np.full(max(n, 1 << 16), b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up, self.down


BYTE_POWERS, RUN_POWERS, RUN_POWERS_2 = Powers(BYTE_BASE), Powers(RUN_BASE), Powers(RUN_BASE_2)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    hash: np.ndarray  # uint64 of each word
    first: np.ndarray  # first word of each text, then the number of words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores in front where a column of the table has it, whatever its case."""
    taken = {x.lower() for x in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row groups of the batch with about ``limit`` text bytes each, one row at least."""
    _, at = text_bytes(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: pa.Array, separators: np.ndarray = SPACES, table: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are no separator; ``table`` maps bytes before hashing."""
    data, at = text_bytes(texts)
    if table is not None:
        data = table[data]
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        starts[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    if len(data) <= PIECE_BYTES or not len(start):
        return Words(data, start, end, _hash(data, start, end), first)
    out, word = [], 0
    while word < len(start):
        to = max(word + 1, int(np.searchsorted(end, start[word] + PIECE_BYTES, "right")))
        low, high = start[word], end[to - 1]
        out.append(_hash(data[low:high], start[word:to] - low, end[word:to] - low))
        word = to
    return Words(data, start, end, np.concatenate(out), first)


def run_hashes(values: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values (runs over text borders included)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = (RUN_POWERS_2 if second else RUN_POWERS).get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((mix64(~values) if second else values) * up[: len(values)], out=total[1:])
    return mix64((total[length:] - total[:n]) * down[:n])
