"""Held-out passages inside training texts, found by spaced seeds.

A seed is a hash over four words at the places that a mask keeps; the places it leaves out may hold anything, so a misread word there does no harm.
Seeds of the passages are joined with the seeds of every text, and around each hit the two word sequences are compared, tolerating the
character changes of misreading and wrong encoding, until the longest common run is known.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glimmerframe.llm import cues

MASKS = ("1111", "11011", "101101", "1100011", "1010101")
BITS = 22


def word_hash(word: str) -> int:
    """A 64-bit hash that is equal in every process."""
    h = 0xCBF29CE484222325
    for byte in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


class Codes(dict):
    """word -> hash of its bare skeleton; 0 for what is no word."""

    def __init__(self) -> None:
        self.skeletons = cues.Skeletons()

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = word_hash(cues.bare(word)) if self.skeletons[word] else 0
        return code


def seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every place where the mask fits."""
    n = len(codes) - len(mask) + 1
    h = np.full(max(0, n), 0x9E3779B97F4A7C15 ^ int(mask, 2), np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1" and n > 0:
            h = (h ^ codes[i : i + n]) * np.uint64(0x9DDFEA08EB382D69)
            h ^= h >> np.uint64(29)
    return h


class Items:
    """A block of passages with their seeds, sorted by hash, and a bit table that passes few other hashes."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        codes = Codes()
        self.ids, self.bones, self.codes, found = [], [], [], []
        for item, words in rows:
            array = np.array([codes[w] for w in words], np.uint64)
            for m, mask in enumerate(MASKS):
                h = seeds(array, mask)
                found.append((h, np.full(len(h), len(self.ids)), np.arange(len(h)), np.full(len(h), m)))
            self.ids.append(item)
            self.codes.append([codes[w] for w in words])
            self.bones.append([codes.skeletons[w] for w in words])
        hashes, item, at, mask = (np.concatenate([np.zeros(0, f[k].dtype) if not len(f[k]) else f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in range(4))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at, self.mask = hashes[order], item[order], at[order], mask[order]
        self.table = np.zeros(1 << BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in codes, item, place in the item) of every seed hit."""
        for m, mask in enumerate(MASKS):
            h = seeds(codes, mask)
            where = np.flatnonzero(self.table[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(where):
                continue
            a, b = np.searchsorted(self.hashes, h[where], "left"), np.searchsorted(self.hashes, h[where], "right")
            for place, i, j in zip(where[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist()):
                for k in range(i, j):
                    if self.mask[k] == m:
                        yield place, int(self.item[k]), int(self.at[k])


def found_in(texts: list[str], items: Items, codes: Codes, least: int) -> Iterator[tuple[int, int]]:
    """(number of the text, number of the item) of every leak in a chunk of texts."""
    words, arrays, sizes = [], [], []
    for text in texts:
        own = [w for w in cues.spoken(text) if codes[w]]
        words.append(own)
        arrays.extend([codes[w] for w in own])
        arrays.extend((0,) * 8)  # no seed spans two texts and hits
        sizes.append(len(own) + 8)
    starts = np.cumsum([0, *sizes])
    if not arrays:
        return
    seen: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    leaks: set[tuple[int, int]] = set()
    for place, item, at in items.hits(np.array(arrays, np.uint64)):
        text = int(np.searchsorted(starts, place, "right")) - 1
        inside = place - int(starts[text])
        own, bones, hashes = words[text], items.bones[item], items.codes[item]
        if inside >= len(own) or (text, item) in leaks:
            continue
        runs = seen.setdefault((text, item, inside - at), [])  # of this diagonal, as far as it has been compared
        if any(a <= inside < b for a, b in runs):
            continue
        ends = []
        for way in (-1, 1):
            p, q = inside, at
            while 0 <= p < len(own) and 0 <= q < len(bones) and (codes[own[p]] == hashes[q] or cues.same(codes.skeletons[own[p]], bones[q])):
                p, q = p + way, q + way
            ends.append(p)
        runs.append((ends[0] + 1, ends[1]))
        if ends[1] - ends[0] - 1 >= least:
            leaks.add((text, item))
            yield text, item


def segments(passage: str, codes: Codes, least: int, most: int) -> Iterator[list[str]]:
    """The words of a passage in stretches of at most `most`, each with the least - 1 words before it, so that every run of least words lies in one of them."""
    words = [w for w in cues.spoken(passage) if codes[w]]
    step = max(1, most - least + 1)
    for a in range(0, max(1, len(words) - least + 1), step):
        if len(words) - a >= least:
            yield words[a : a + step + least - 1]


def blocks(items: DataFrame, item_col: str, passage_col: str, least: int, most: int) -> Iterator[bytes]:
    """Indexes of all passages, built in tasks, each of at most `most` words, one at a time."""
    kind = f"`{item_col}` {items.schema[item_col].dataType.simpleString()}"
    known = items.filter(items[passage_col].isNotNull() & items[item_col].isNotNull()).select(item_col, items[passage_col].cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            found = [(i, words) for i, passage in enumerate(batch.column(1).to_pylist()) for words in segments(passage, codes, least, most)]
            taken = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array([w for _, w in found], pa.list_(pa.string())), pa.array([len(w) for _, w in found], pa.int64())], [item_col, "words", "n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": [pickle.dumps(Items(rows))]})

        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows and held + len(words) > most:
                    yield made()
                    rows, held = [], 0
                rows.append((item, words))
                held += len(words)
        if rows:
            yield made()

    words = known.mapInArrow(cut, f"{kind}, words array<string>, n long")
    total = words.agg(F.sum("n")).first()[0] or 0
    for row in words.repartition(max(1, -(-total // most))).mapInArrow(index, "block binary").toLocalIterator():
        yield row.block


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least_words: int = 12, block_words: int = 400_000) -> DataFrame:
    """(id_col, item_col), without repeats: texts that hold at least least_words consecutive words of a passage.

    Passages are the small, held-out side. They are indexed in blocks of at most block_words words (about 60 MB broadcast; longer passages are cut with an overlap, and words are counted as they are
    compared), each block joined with all texts by seed hash, so what is broadcast has a bound and any number of passages is handled, with one scan of the texts a block; the texts are never
    shuffled. Null and empty texts and passages, and passages of fewer than least_words words, are never part of a leak; repeated rows give one result row; empty tables
    give an empty result; other columns are ignored. Very long texts are searched whole.
    """
    kinds = f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}"
    sc = documents.sparkSession.sparkContext
    item_type = to_arrow_type(items.schema[item_col].dataType)
    texts = documents.select(id_col, documents[text_col].cast("string").alias("__text"))

    def over(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, codes = pickle.loads(block.value), Codes()
            for batch in batches:
                ids = batch.column(0)
                column = batch.column(1).to_pylist()
                rows, chunk, size = [], [], 0
                for i, text in enumerate(column):
                    if text:
                        chunk.append(i)
                        size += len(text)
                    if chunk and (size > 1_000_000 or i == len(column) - 1):
                        rows += [(chunk[t], held.ids[k]) for t, k in found_in([column[c] for c in chunk], held, codes, least_words)]
                        chunk, size = [], 0
                taken = ids.take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array([r[1] for r in rows], item_type)], [id_col, item_col])

        return texts.mapInArrow(run, kinds)

    parts = [over(sc.broadcast(index)) for index in blocks(items, item_col, passage_col, least_words, max(block_words, 2 * least_words))]
    result = parts[0] if parts else texts.limit(0).mapInArrow(lambda batches: iter(()), kinds)
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()
