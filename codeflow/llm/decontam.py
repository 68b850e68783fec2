"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A window of as many words as a benchmark item gets a 256-bit SimHash of its weighted shingles. The fingerprint is cut
into ``BLOCKS`` blocks; of two fingerprints within ``RADIUS`` bits, some block differs in at most RADIUS // BLOCKS bits, so
a look into one table per block at all values so near finds every item within the radius, and one item in six of the
others (at a weighted similarity of 0.8, 39 bits differ on average with a deviation of 6, so the radius lies 4 deviations
off). Items found are held against the window by the exact weighted Jaccard similarity of the shingles, weights being their
counts. Of windows that overlap, the most similar one counts for an item. Windows of which too few shingles
occur in items of its size cannot reach the similarity (at least 2t/(1+t) of the shingles must be shared), and get no
fingerprint; that loses none. A document with fewer words than an item is held against it as a whole: the items that
share enough of its shingles are looked up exactly. The benchmark is read in blocks of a fixed number of items, each a pass over the documents.

Defined results: null and empty texts and items without a word match nothing; an item of fewer than five words is one
shingle of its whole sequence; repeated items match under each of their ids; a null item_id is left out; repeated rows
match each; a null doc_id is reported as null (and its row stays when matches are dropped by flag, not by id); empty
tables give an empty result. Only doc_id, text, item_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, bounded, code_points, flat, mix, pieces, shingle_hashes, word_hashes, words

#: Bits of a fingerprint, its blocks, and bits in which fingerprints may differ.
BITS, BLOCKS, RADIUS = 256, 16, 63
#: Items that one pass over the documents looks for.
ITEMS_A_PASS = 20_000
_LANES = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS zeros and ones for each shingle."""
    lanes = np.stack([mix(shingles ^ lane) for lane in _LANES], 1)
    return np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of the shingles, each counted as often as it is given: BITS zeros and ones."""
    return (2 * _signs(shingles).sum(axis=0, dtype=np.int64) > len(shingles)).astype(np.uint8)


def blocks_of(print_: np.ndarray) -> np.ndarray:
    """The numbers of the blocks."""
    return print_.reshape(BLOCKS, -1) @ (1 << np.arange(BITS // BLOCKS))


@lru_cache(1)
def _near() -> np.ndarray:
    """Masks of at most RADIUS // BLOCKS bits of a block."""
    bits = [1 << i for i in range(BITS // BLOCKS)]
    return np.array([sum(c) for n in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(bits, n)])


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets of (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _weights(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


@dataclass
class Tables:
    """For each block the items in order of its value, and where each value begins."""

    prints: np.ndarray  # packed bits
    order: np.ndarray  # BLOCKS x items
    bounds: np.ndarray  # BLOCKS x (values + 1)

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """The items of which some block is near that of the fingerprint."""
        at = blocks_of(print_)[:, None] ^ _near()[None, :]
        block = np.arange(BLOCKS)[:, None]
        low, high = self.bounds[block, at], self.bounds[block, at + 1]
        k, j = np.nonzero(high > low)
        low, n = low[k, j], (high - low)[k, j]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(self.order[np.repeat(k, n), np.repeat(low, n) + within])

    def within(self, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All items within the radius, and the bits in which they differ."""
        found = self.candidates(print_)
        differ = np.bitwise_count(self.prints[found] ^ np.packbits(print_)).sum(axis=1, dtype=np.int64)
        return found[differ <= RADIUS], differ[differ <= RADIUS]


@dataclass
class Index:
    """Items in arrays: some 600 bytes and 50 for each shingle, whatever is asked."""

    ids: np.ndarray
    words_of: np.ndarray
    prints: np.ndarray  # packed bits
    at: np.ndarray  # where each item's weights begin
    keys: np.ndarray
    counts: np.ndarray
    tables: Tables
    known: np.ndarray  # all shingles, sorted
    sizes_at: np.ndarray  # where each shingle's sizes begin
    sizes: np.ndarray  # the sizes of the items that hold it
    holders_at: np.ndarray  # where each shingle's items begin
    holders: np.ndarray  # the items that hold it

    def weights(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[item], self.at[item + 1])
        return self.keys[part], self.counts[part]

    def sizes_of(self, shingle: int) -> list[int]:
        k = int(np.searchsorted(self.known, np.uint64(shingle)))
        return self.sizes[self.sizes_at[k] : self.sizes_at[k + 1]].tolist()

    def like(self, weights: tuple[np.ndarray, np.ndarray], beyond: int, k: int, least: float) -> list[tuple[int, float]]:
        """(item, similarity) of all items of more than ``beyond`` words, at least k, that reach the similarity."""
        at = np.searchsorted(self.known, weights[0])
        items = np.concatenate([np.zeros(0, np.int32), *(self.holders[self.holders_at[x] : self.holders_at[x + 1]] for x in at[np.isin(weights[0], self.known)].tolist())])
        items, shared = np.unique(items, return_counts=True)
        words_of, own, distinct = self.words_of[items], int(weights[1].sum()), len(weights[0])
        # of the distinct shingles at most own - distinct more are shared by weight
        maybe = (words_of >= max(k, beyond + 1)) & (shared + own - distinct >= least / (1 + least) * (own + words_of - k + 1) - 1e-9)
        found = [(x, weighted_similarity(weights, self.weights(x))) for x in items[maybe].tolist()]
        return [(x, like) for x, like in found if like >= least - 1e-12]


def build(rows: list[tuple[int, str]], k: int) -> Index:
    data, off = flat(pa.array([t for _, t in rows], pa.string()))
    starts, ends, first = words(data, off, ALNUM)
    h, begin = shingle_hashes(word_hashes(data, starts, ends), first, k)
    n = np.diff(first)
    ids, weights, prints, words_of = [], [], [], []
    for i in np.flatnonzero(n).tolist():
        own = h[begin[i] : begin[i + 1]]
        ids.append(rows[i][0])
        weights.append(_weights(own))
        prints.append(fingerprint(own))
        words_of.append(int(n[i]))
    at = np.concatenate([[0], np.cumsum([len(w[0]) for w in weights])]).astype(np.int64)
    keys, counts = np.concatenate([np.zeros(0, np.uint64), *(w[0] for w in weights)]), np.concatenate([np.zeros(0, np.int64), *(w[1] for w in weights)]).astype(np.int32)
    size = np.array(words_of, np.int64)
    packed = np.stack([np.packbits(x) for x in prints]) if prints else np.zeros((0, BITS // 8), np.uint8)
    values = np.array([blocks_of(x) for x in prints], np.int64).reshape(-1, BLOCKS)
    order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
    bounds = np.stack([np.searchsorted(np.sort(values[:, j]), np.arange((1 << BITS // BLOCKS) + 1)) for j in range(BLOCKS)]).astype(np.int32)
    tables = Tables(packed, order, bounds)
    pairs = np.unique(np.stack([keys, np.repeat(size, np.diff(at)).astype(np.uint64)], 1), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
    known, sizes_at = np.unique(pairs[:, 0], return_index=True)
    order = np.argsort(keys, kind="stable")
    holders = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))[order]
    holders_at = np.concatenate([np.searchsorted(keys[order], known), [len(keys)]])
    return Index(np.array(ids, np.int64), size, packed, at, keys, counts, tables, known, np.concatenate([sizes_at, [len(pairs)]]), pairs[:, 1].astype(np.int64), holders_at, holders)


def _short(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one row, as shingle_hashes makes them of a whole sequence of k words."""
    return shingle_hashes(h, np.array([0, len(h)]), k)[0] if len(h) >= k else np.zeros(0, np.uint64)


def _apart(found: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Of (similarity, first word, words, bits) those that overlap no better one."""
    kept: list[tuple[int, int, float, int]] = []  # first word, end, similarity, bits: in order
    for like, c, n, bits in sorted(found, key=lambda x: (-x[0], x[1])):
        i = bisect.bisect_left(kept, (c,))
        if (i == 0 or kept[i - 1][1] <= c) and (i == len(kept) or c + n <= kept[i][0]):
            kept.insert(i, (c, c + n, like, bits))
    return [(like, c, end - c, bits) for c, end, like, bits in kept]


def _matches(index: Index, k: int, least: float, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, float, int]]:
    """(row, item, begin byte, end byte, similarity, bits that differ): the windows of each item in each row, of those that
    overlap the best; where the item has more words than the row, the whole row is the window."""
    filter_ = np.zeros(1 << 20, bool)
    filter_[(index.known >> np.uint64(44)).astype(np.int64)] = True
    brief = sorted(set(index.words_of[index.words_of < k].tolist()))
    for a, b in pieces(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = words(part, at, ALNUM)
        h = word_hashes(part, starts, ends)
        s, begin = shingle_hashes(h, first, k)
        mark = filter_[(s >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(mark)
        mark[maybe] = np.isin(s[maybe], index.known)
        hits = np.flatnonzero(mark)
        rows = np.unique(np.searchsorted(begin, hits, "right") - 1) if not brief else np.arange(b - a)
        for i in rows.tolist():
            found: dict[int, list[tuple[float, int, int, int]]] = {}
            own = s[begin[i] : begin[i + 1]]
            seen = mark[begin[i] : begin[i + 1]]
            where: dict[int, list[int]] = {}  # a window can only be like items of its size, so only their shingles count
            for c, x in zip(np.flatnonzero(seen).tolist(), own[seen].tolist(), strict=True):
                for n in index.sizes_of(x):
                    where.setdefault(n, []).append(c)
            n_words = int(first[i + 1] - first[i])
            for n in [*brief, *sorted(n for n in where if n >= k)]:
                if n_words < n:
                    break
                if n < k:
                    grams, m = _short(h[first[i] : first[i + 1]], n), 1
                    candidates = np.flatnonzero(np.isin(grams, index.known))
                else:
                    grams, m = own, n - k + 1
                    need = math.ceil(2 * least / (1 + least) * m - 1e-9)
                    if len(where[n]) < need:
                        continue
                    at_ = np.array(where[n])
                    around = np.unique(at_[:, None] - np.arange(m - need + 1)[None, :])  # the first known shingle stands among these
                    around = around[(around >= 0) & (around + m <= len(own))]
                    candidates = around[np.searchsorted(at_, around + m) - np.searchsorted(at_, around) >= need]
                for c in candidates.tolist():
                    window, weights = grams[c : c + m], None
                    for x, differ in zip(*index.tables.within(fingerprint(window)), strict=True):
                        if index.words_of[x] == n:
                            weights = weights or _weights(window)
                            like = weighted_similarity(weights, index.weights(x))
                            if like >= least - 1e-12:
                                found.setdefault(int(x), []).append((like, c, n, int(differ)))
            longest = k - 1 + int((n_words - k + 1) / least + 1e-9)  # words of the longest item that the whole row can be like
            whole = [n for n in where if n_words < n <= longest]
            if n_words >= k and any(len(where[n]) >= least * (n - k + 1) - 1e-9 for n in whole):
                bits = None
                for x, like in index.like(_weights(own), n_words, k, least):
                    bits = np.packbits(fingerprint(own)) if bits is None else bits
                    found[x] = [(like, 0, n_words, int(np.bitwise_count(index.prints[x] ^ bits).sum()))]
            for x, windows in sorted(found.items()):
                for like, c, n, differ in _apart(windows):
                    yield a + i, int(index.ids[x]), int(starts[first[i] + c] - at[i]), int(ends[first[i] + c + n - 1] - at[i]), like, differ


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows: list[tuple[int, str]] = []
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == ITEMS_A_PASS:
            yield rows
            rows = []
    yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each window of a document that is like an item, without those that overlap a window more like it: doc_id,
    item_id, start, end (code points), similarity, bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("bits", pa.int32())])

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = flat(batch.column(1))
                rows = []
                last, byte, char = (-1, -1), 0, 0  # the windows of an item come in order
                for i, item, x, y, like, bits in _matches(index, k, similarity, data, off):
                    if (i, item) != last:
                        last, byte, char = (i, item), off[i], 0
                    start = char + code_points(data, byte, off[i] + x)
                    byte, char = off[i] + y, start + code_points(data, off[i] + x, off[i] + y)
                    rows.append((batch.column(0)[i].as_py(), item, start, char, like, bits))
                yield pa.record_batch([pa.array([r[j] for r in rows], schema.types[j]) for j in range(6)], schema=schema)

        return run

    plain, out = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for rows in _blocks(benchmark):
        found = plain.mapInArrow(finder(build(rows, k)), "doc_id long, item_id long, start long, end long, similarity double, bits int")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Null and empty texts hold none; a row with a
    null id, and each of repeated rows, is judged by its text; with an empty benchmark all rows stay."""
    schema, at = docs.schema, docs.columns.index("text")

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in _matches(index, k, similarity, *flat(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for rows in _blocks(benchmark):
        docs = bounded(docs).mapInArrow(keeper(build(rows, k)), schema)
    return docs
