"""Byte-level BPE: texts to token ids with byte offsets, and back.

Pre-tokens are found without a regular expression. Every code point has a class; with the one or two
code points that follow, it becomes a symbol; a symbol is a transition function of a small automaton.
Functions compose, and composition is associative, so blocks of text are reduced side by side, the
blocks' functions are scanned, and all blocks are then run from their true first states at once.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from metricloom.llm.words import slices, text_bytes

WINDOW = 1 << 19  # bytes of text cut into pre-tokens at once
BLOCK = 64  # code points per block of the scan
CACHED_PIECES, CACHED_BYTES = 400_000, 16 << 20  # the cache of merged pieces is emptied beyond these
SHORT = 64  # shorter pieces are merged in place, longer ones with a heap

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# symbols: a contraction's apostrophe by its length, a blank or white space before a visible
# character, other white space; each once more for the first code point of a text
LET, NUM, OTH, SHORT_END, LONG_END, LAST_BLANK, LAST_SPACE, IN_SPACE = range(8)
FIRST = 8
# states: what the token at hand is; a joined blank, one or two letters left of a contraction
FRESH, IN_LET, IN_NUM, IN_OTH, JOINED, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)
STARTS = 8  # flag of a move that begins a token


def _moves() -> np.ndarray:
    """Next state of every (symbol, state), with ``STARTS`` where a token begins."""
    to = {LET: IN_LET, NUM: IN_NUM, OTH: IN_OTH, SHORT_END: ONE_LEFT, LONG_END: TWO_LEFT, LAST_BLANK: JOINED, LAST_SPACE: FRESH, IN_SPACE: IN_RUN}
    out = np.zeros((2 * FIRST, 8), np.uint8)
    for symbol, state in to.items():
        out[symbol, :] = out[symbol + FIRST, :] = state | STARTS
    for symbol, own in ((LET, IN_LET), (NUM, IN_NUM), (OTH, IN_OTH)):
        out[symbol, [own, JOINED]] = own
    # an apostrophe inside a run of signs, or after a joined blank, belongs to the run
    out[[SHORT_END, LONG_END], IN_OTH] = out[[SHORT_END, LONG_END], JOINED] = IN_OTH
    out[LET, [ONE_LEFT, TWO_LEFT]] = FRESH, ONE_LEFT
    out[IN_SPACE, IN_RUN] = IN_RUN
    return out


MOVES = _moves()
NEXT = (MOVES & 7).ravel()
MOVES = MOVES.ravel()


@cache
def class_table() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the tokenizer library itself."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        some = bytes(found.encode_ordinary(everything)).decode().encode("utf-32-le")
        out[np.frombuffer(some, "<u4")] = kind
    out[0x20] = BLANK
    return out


def symbols(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``at`` has the first code point of each text, then their number."""
    n = len(points)
    kind = class_table()[points]
    starts = np.unique(at[at < n])
    last = np.zeros(n, bool)
    last[np.append(starts[1:], n) - 1] = True
    white = kind >= BLANK
    out = np.choose(kind, [np.uint8(LET), np.uint8(NUM), np.uint8(OTH), np.uint8(IN_SPACE), np.uint8(IN_SPACE)]).astype(np.uint8)
    before = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    out[before] = np.where(kind[before] == BLANK, LAST_BLANK, LAST_SPACE)
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[~last[marks]]
    one = points[marks + 1]
    out[marks[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT_END
    far = marks[~last[marks + 1]]
    pair = points[far + 1].astype(np.uint64) << np.uint64(32) | points[far + 2].astype(np.uint64)
    out[far[np.isin(pair, np.array([ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")], np.uint64))]] = LONG_END
    out[starts] += FIRST
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each symbol, by a scan of transition functions."""
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.intp) * 8
    # each block's symbols composed to one function
    whole = np.repeat(np.arange(8, dtype=np.uint8)[None, :], rows, axis=0)
    for column in grid:
        whole = NEXT.take(column[:, None] + whole)
    # inclusive scan of the blocks' functions: after step k a row holds the last 2**k blocks
    step = 1
    while step < rows:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(grid):
        moved = MOVES.take(column + state)
        out[j] = moved >= STARTS
        state = moved & 7
    return out.T.ravel()[:n]


def pre_tokens(data: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets of the pre-tokens of texts that begin at bytes ``at``."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(width) - width
    return offset[token_starts(symbols(points, np.searchsorted(offset, at)))]


def windows(data: np.ndarray, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """One long text in parts that begin and end at pre-tokens, with their pre-tokens.

    A pre-token is read on from its start alone, so a new part may begin at any. Whether one starts
    at a code point is certain once the two that follow are seen.
    """
    at, reach = 0, size
    while at < len(data):
        end = min(len(data), at + reach)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        part = data[at:end].tobytes()
        starts = pre_tokens(part, np.zeros(1, np.int64))
        if end < len(data):
            # three code points have twelve bytes at most
            sure = starts[starts <= len(part) - 12]
            if len(sure) < 2:
                reach *= 2
                continue
            part, starts = part[: sure[-1]], sure[:-1]
        yield part, starts
        at, reach = at + len(part), size


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined, the leftmost of equals, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) < SHORT:
        get, none = ranks.get, 1 << 60
        edge = list(range(len(piece) + 1))
        pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair and (rank := min(pair)) < none:
            i = pair.index(rank)
            del edge[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[edge[i] : edge[i + 2]], none)
            if i:
                pair[i - 1] = get(piece[edge[i - 1] : edge[i + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(edge, edge[1:])]
    n = len(piece)
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
    gone = bytearray(n + 1)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : after[j]])) is not None:
            heapq.heappush(heap, (rank, i, after[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue  # one of the pair has been joined otherwise
        gone[j] = 1
        after[i] = end
        if end <= n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """Slot of every pre-token met, merged when first asked for; slots point into one array of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.ids, self.first, self.bytes = array("i"), array("q", [0]), 0

    def __missing__(self, piece: bytes) -> int:
        self.ids.extend(merge(piece, self.ranks))
        self.first.append(len(self.ids))
        self.bytes += len(piece)
        self[piece] = slot = len(self)
        return slot

    def look_up(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        if len(self) > CACHED_PIECES or self.bytes > CACHED_BYTES:
            self.empty()
        slot = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        first = np.array(self.first, np.int64)
        return gather(np.array(self.ids, np.int32), first[slot], np.diff(first)[slot])


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[start : start + count]`` one after the other."""
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(len(shift))], count


class Codec:
    """Ranks of a vocabulary: one line for each token, its bytes in base 64 and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pieces = Pieces(self.ranks)
        size = max(self.ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        self.start = np.zeros(size, np.int64)
        at = 0
        for token, rank in self.ranks.items():
            self.length[rank], self.start[rank] = len(token), at
            at += len(token)
        self.flat = np.frombuffer(b"".join(self.ranks), np.uint8)

    def encode(self, data: np.ndarray, at: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at bytes ``at`` of ``data``, and where each text's ids begin."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        if len(at) == 2 and len(data) > size:
            parts = [self.pieces.look_up(self.cut(part, starts))[0] for part, starts in windows(data, size)]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)], np.int64)
        text = data.tobytes()
        starts = pre_tokens(text, at[:-1])
        ids, count = self.pieces.look_up(self.cut(text, starts))
        before = np.append(0, np.cumsum(count))
        return ids, before[np.searchsorted(starts, at)]

    @staticmethod
    def cut(text: bytes, starts: np.ndarray) -> list[bytes]:
        ends = np.append(starts[1:], len(text)).tolist()
        return [text[a:b] for a, b in zip(starts.tolist(), ends)]

    def decode(self, ids: np.ndarray) -> np.ndarray | None:
        """Bytes of the tokens; None where an id is no token."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or self.length[ids].min() < 0):
            return None
        return gather(self.flat, self.start[ids], self.length[ids])[0]


@cache
def codec(path: str | None) -> Codec:
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _numbered(docs: DataFrame) -> DataFrame:
    """The table with plain column names, as Spark's map over batches asks for names without dots."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def _place(docs: DataFrame, name: str) -> int:
    return [x.lower() for x in docs.columns].index(name.lower())


def _others(schema: StructType, names: list[str]) -> list[int]:
    """Places of the columns that are not among ``names``."""
    low = {x.lower() for x in names}
    return [k for k, f in enumerate(schema.fields) if f.name.lower() not in low]


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, ids: str = "ids", ends: str = "token_ends", keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of every whole text and the byte offset at which each token ends.

    ``ranks`` is the path of a rank file that every executor can read; without it the installed 50k
    vocabulary is taken. Special tokens are never made. Map-only and row by row: repeated rows give
    repeated results, an empty table an empty one, null and empty texts an empty list. Columns named
    like the two new ones are replaced, all others stay. A task works on half a MB of text at a
    time; longer texts are cut where a pre-token starts, which changes nothing in the result.
    """
    kept, at = _others(docs.schema, [ids, ends, *([] if keep_text else [text])]), _place(docs, text)
    schema = StructType([docs.schema.fields[k] for k in kept] + [StructField(x, ArrayType(IntegerType(), False), False) for x in (ids, ends)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for part in slices(batch, f"c{at}", WINDOW):
                found, first = own.encode(*text_bytes(part.column(at)))
                end = np.cumsum(own.length[found])
                end -= np.repeat(np.append(0, end)[first[:-1]], np.diff(first))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (found, end)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *lists], names)

    return _numbered(docs).mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", ranks: str | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that each list of ids stands for, in place of the ids.

    A null list, or one with a null or an id that is no token, gives null; an empty list no bytes.
    """
    kept, at = _others(docs.schema, [ids, out]), _place(docs, ids)
    schema = StructType([docs.schema.fields[k] for k in kept] + [StructField(out, BinaryType(), True)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            lists, made = batch.column(at), []
            row, held = 0, 0
            for k in range(len(lists)):
                values = lists[k].values
                plain = values is not None and not values.null_count
                found = own.decode(values.to_numpy()) if plain else None
                made.append(None if found is None else found.tobytes())
                held += 0 if found is None else len(found)
                if held > WINDOW or k + 1 == len(lists):
                    yield pa.RecordBatch.from_arrays([*[batch.column(x).slice(row, k + 1 - row) for x in kept], pa.array(made, pa.binary())], names)
                    row, held, made = k + 1, 0, []

    return _numbered(docs).mapInArrow(run, schema)


def token_bytes(text: Column, ends: Column, first: Column, count: Column) -> Column:
    """Bytes of ``count`` tokens from the 0-based token ``first`` on, cut out of the text by the offsets."""
    start = F.when(first > 0, F.get(ends, first - 1)).otherwise(0)
    stop = F.get(ends, F.least(first + count, F.size(ends)) - 1)
    return F.substring(F.encode(text, "utf-8"), start + 1, stop - start)
