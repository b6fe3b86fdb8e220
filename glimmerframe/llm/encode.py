"""Corpus encoding with a public byte-level BPE vocabulary.

Pre-tokenisation runs without a regex engine: every code point gets a class from a table, one look-ahead turns classes into symbols, and a
finite automaton over those symbols decides where tokens begin. The automaton is evaluated as an associative scan over transition functions
(blocks of text are composed in parallel, block functions are combined by doubling, and a second sweep replays each block from its known start
state), so the work is a fixed number of array operations whatever the texts look like. Slices between boundaries are merged by ranked byte pairs;
the result of every distinct slice is cached.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Symbols: letter, number, other, apostrophe opening a 1- or 2-letter contraction, blank before text, other space before text, inner space.
LET, NUM, OTH, AP1, AP2, SP, WSL, WS = range(8)
# States: at a token start, in letters, in numbers, in others, after an absorbed blank, in a space run, two or one contraction letters to come.
S0, SL, SN, SO, SA, SW, SC2, SC1 = range(8)
# The code points with the Unicode property White_Space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LANE = 512
CACHED = 400_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    step, out = np.zeros((16, 8), np.uint8), np.ones((16, 8), np.uint8)
    for state in range(8):
        for symbol, (to, inside) in {
            LET: (SL, (SL, SA)), NUM: (SN, (SN, SA)), OTH: (SO, (SO, SA)), AP1: (SC1, ()), AP2: (SC2, ()), SP: (SA, ()), WSL: (S0, ()), WS: (SW, (SW,)),
        }.items():
            if symbol in (AP1, AP2) and state in (SO, SA):
                to, inside = SO, (SO, SA)
            if symbol == LET and state in (SC2, SC1):
                to, inside = (SC1 if state == SC2 else S0), (state,)
            step[symbol, state], out[symbol, state] = to, state not in inside
    for symbol in range(8):  # the first character of a text forgets what came before
        step[8 + symbol], out[8 + symbol] = step[symbol, S0], out[symbol, S0]
    return step.ravel(), out.ravel()


STEP, OUT = _automaton()


@cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTH, np.uint8)
    kinds = {"L": LET, "N": NUM}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    table[WHITE] = WS
    return table


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of every code point; firsts are the places where texts begin."""
    kind = classes()[points]
    last = np.zeros(len(points), bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    space = kind == WS
    before_text = np.zeros(len(points), bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    kind[before_text] = np.where(points[before_text] == 32, SP, WSL)
    quote = np.flatnonzero((points == 39) & ~last)
    if len(quote):
        one = points[quote + 1]
        kind[quote[np.isin(one, [ord(c) for c in "sdmt"])]] = AP1
        deep = ~last[quote + 1]
        quote, one = quote[deep], one[deep]
        two = points[quote + 2]
        for a, b in ("ll", "ve", "re"):
            kind[quote[(one == ord(a)) & (two == ord(b))]] = AP2
    kind[firsts] += 8
    return kind


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Where tokens begin: an associative scan of the symbols' transition functions."""
    n = len(symbol)
    lanes = -(-n // LANE)
    padded = np.full(lanes * LANE, WS, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T).astype(np.uint16) << 3
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, 1)
    for j in range(LANE):
        whole = STEP[columns[j] + whole]
        if len(whole) > 1 and j % 8 == 7 and (whole == whole[0]).all():
            whole = whole[:1]  # every block's function has become constant
    if len(whole) == 1:
        whole = np.repeat(whole, 8, 0)
    reach = 1
    while reach < lanes:  # inclusive scan by doubling: the function of blocks 0..l
        later = whole[whole[:, :-reach], np.arange(reach, lanes)]
        whole = np.concatenate([whole[:, :reach], later], 1)
        reach *= 2
    state = np.concatenate([[S0], whole[S0, :-1]]).astype(np.uint8)
    begins = np.empty((LANE, lanes), np.uint8)
    for j in range(LANE):
        at = columns[j] + state
        begins[j] = OUT[at]
        state = STEP[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class Pieces(dict):
    """Slice -> number of its merged ids in the pool."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.ids, self.sizes = ranks, [], []

    def __missing__(self, piece: str) -> int:
        ids = merge(piece.encode(errors="replace"), self.ranks)
        self.ids.extend(ids)
        self.sizes.append(len(ids))
        self[piece] = len(self.sizes) - 1
        return len(self.sizes) - 1


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined until none is in the vocabulary."""
    if raw in ranks:
        return [ranks[raw]]
    parts = [raw[i : i + 1] for i in range(len(raw))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, for slices so long that rescanning would be quadratic."""
    from heapq import heapify, heappop, heappush

    after = [*range(1, len(parts)), -1]
    ahead = [-1, *range(len(parts) - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if parts[i] is not left or j < 0 or parts[j] is not right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] >= 0:
            ahead[after[i]] = i
        for a in (ahead[i], i):
            if a >= 0 and (b := after[a]) >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heappush(heap, (r, a, parts[a], parts[b]))
    return [ranks[p] for p in parts if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._fresh()

    def _fresh(self) -> None:
        self.pieces = Pieces(self.ranks)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.sizes, self.at = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _which(self, whole: str, points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece number of every slice a..b. Slices of up to 8 Latin-1 characters are looked up as packed integers, others one by one."""
        narrow = np.zeros(len(points) + 8, np.uint8)
        narrow[: len(points)] = np.where(points < 256, points, 0)
        size = b - a
        packed, short = np.zeros(len(a), np.uint64), size <= 8
        for k in range(8):
            inside = size > k
            byte = np.where(inside, narrow[a + k], 0).astype(np.uint64)
            short &= ~inside | (byte > 0)
            packed |= byte << np.uint64(8 * k)
        which = np.full(len(a), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, packed), len(self.keys) - 1)
            known = short & (self.keys[at] == packed)
            which[known] = self.values[at[known]]
        rest = np.flatnonzero(which < 0)
        which[rest] = np.fromiter(map(self.pieces.__getitem__, map(whole.__getitem__, map(slice, a[rest].tolist(), b[rest].tolist()))), np.int64, len(rest))
        new = rest[short[rest]]
        if len(new):
            keys, first = np.unique(np.concatenate([self.keys, packed[new]]), return_index=True)
            self.keys, self.values = keys, np.concatenate([self.values, which[new]])[first]
        return which

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of non-empty texts: flat ids, the number of ids of each text, and for each id the code point in its text where its slice begins."""
        if len(self.pieces) > CACHED:
            self._fresh()
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(lengths) - lengths
        begins = boundaries(symbols(points, firsts))
        which = self._which(whole, points, begins, np.append(begins[1:], len(whole)))
        if len(self.sizes) < len(self.pieces.sizes):
            self.pool, self.sizes = np.array(self.pieces.ids, np.int32), np.array(self.pieces.sizes, np.int64)
            self.at = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.at[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(begins, np.append(firsts, len(whole)))]
        text_of = np.searchsorted(firsts, begins, "right") - 1
        return flat, np.diff(upto), np.repeat(begins - firsts[text_of], sizes)


def _chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False, chunk_chars: int = 1_000_000) -> DataFrame:
    """(id_col, ids array<int>) of every row, in no order and without a shuffle; with_offsets adds offsets array<int>.

    vocabulary: path of a rank file (base64 token, blank, rank), read on the driver and broadcast: its size is that of a vocabulary, whatever the
    corpus. No special tokens: their spelling is ordinary text. Null text and empty text give an empty list; repeated rows and ids are kept as they
    are; an empty table gives an empty result; other columns are not carried along, so their names cannot clash. Texts are encoded whole, however
    long (chunk_chars only groups short ones). offsets hold, for every id, the code point of the text where its slice begins.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    ids = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>" + ", offsets array<int>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            counts, flats, places = np.zeros(len(texts), np.int64), [], []
            full = np.array([i for i, t in enumerate(texts) if t], np.int64)
            done = 0
            for chunk in _chunks([t for t in texts if t], chunk_chars):
                flat, sizes, at = encoder.encode(chunk)
                counts[full[done : done + len(chunk)]] = sizes
                done += len(chunk)
                flats.append(flat)
                places.append(at)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [batch.column(0)]
            for x in (flats, places)[: 1 + with_offsets]:
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "offsets"][: len(columns)])

    return df.select(id_col, df[text_col].cast("string").alias("__text")).mapInArrow(run, ids)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids; the inverse of encoding for every text of valid Unicode."""
    back = {i: token for token, i in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
