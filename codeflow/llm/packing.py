"""Variable-capacity best-fit packing of token sequences.

Only the histogram of lengths (at most one row per length up to the largest capacity) goes to the driver. There lengths
are packed in falling order: each piece goes to the open bin with the least room that holds it; if none does, a bin of
the capacity with the least cost per token that the remaining lengths can put into it is opened; at the end every bin
shrinks to the least permitted capacity that holds its contents. Equal bins are one entry with a multiplicity, so the
plan's size depends on the lengths, not on the number of documents. Pieces then find their bins by their rank among the
pieces of the same length.

A document has one token per word (white space between) and one end token; one longer than the largest capacity is cut
into pieces of that size and a rest. Defined results: null and empty texts are one piece of one token; a null doc_id
stays null; repeated rows are packed each (which of two equal rows comes first does not matter); an empty table gives an
empty result. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, flat, pieces, small, words

#: Permitted sequence lengths.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Rows of one rank task: lengths with more pieces, or with more than their part of all pieces, are ranked in several.
RANK_ROWS, RANK_PARTS = 250_000, 512


def cost(capacity: int) -> float:
    """Work of a sequence: linear layers and attention, with a fixed share per sequence."""
    return capacity * (1 + capacity / 16384) + 16


@dataclass
class Run:
    """``bins`` equal bins from number ``first`` on, with ``room`` left and ``used`` filled."""

    first: int
    bins: int
    room: int
    used: int


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, price=cost) -> tuple[list[tuple[int, int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Segments (length, first rank, first bin, pieces a bin, offset in the bin, pieces), then for runs of bins their
    first numbers and final capacities."""
    capacities = tuple(sorted(capacities))
    open_runs: dict[int, list[Run]] = {}
    rooms: list[int] = []
    segments: list[tuple[int, int, int, int, int, int]] = []
    closed: list[Run] = []
    bins = 0
    left = sorted((n, c) for n, c in histogram.items() if c > 0)
    lengths = [n for n, _ in left]

    def put(run: Run) -> None:
        if run.room < (lengths[0] if lengths else 1) or not run.room:
            closed.append(run)
            return
        if run.room not in open_runs:
            open_runs[run.room] = []
            bisect.insort(rooms, run.room)
        open_runs[run.room].append(run)

    def fill(run: Run, length: int, rank: int, count: int) -> int:
        """Put up to ``count`` pieces into the run, each bin to the brim; the number put."""
        each = run.room // length
        whole = min(run.bins, count // each)
        if whole:
            segments.append((length, rank, run.first, each, run.used, whole * each))
            put(Run(run.first, whole, run.room - each * length, run.used + each * length))
        rest = min(count - whole * each, each - 1) if whole < run.bins else 0
        if rest:
            segments.append((length, rank + whole * each, run.first + whole, rest, run.used, rest))
            put(Run(run.first + whole, 1, run.room - rest * length, run.used + rest * length))
        if (over := run.bins - whole - bool(rest)) > 0:
            put(Run(run.first + whole + bool(rest), over, run.room, run.used))
        return whole * each + rest

    while left:
        length, count = left.pop()
        lengths.pop()
        lengths_low = lengths or [length]
        rank = 0
        while rank < count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                run = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
                rank += fill(run, length, rank, count - rank)
                continue
            best = None
            for c in capacities:
                if c < length:
                    continue
                each = min(c // length, count - rank)
                filled, room, k = each * length, c - each * length, len(left) - 1
                taken: dict[int, int] = {}
                while room >= lengths_low[0] and k >= 0 and left:  # what the remaining lengths would put into the rest
                    k = min(k, bisect.bisect_right(lengths, room) - 1)
                    if k < 0:
                        break
                    n = min(room // lengths[k], left[k][1] - taken.get(k, 0))
                    filled, room, taken[k] = filled + n * lengths[k], room - n * lengths[k], taken.get(k, 0) + n
                    k -= 1
                fitting = next(x for x in capacities if x >= filled)
                key = (price(fitting) / filled, -c)
                best = min(best, (key, c)) if best else (key, c)
            c = best[1]
            # the same choice again, for as long as there are enough pieces of this length for a bin of any capacity
            each, widest = c // length, capacities[-1] // length
            new = max(0, count - rank - widest) // each + 1
            run = Run(bins, new, c, 0)
            bins += new
            rank += fill(run, length, rank, min(count - rank, new * each))
    ended = sorted([*closed, *(r for rs in open_runs.values() for r in rs)], key=lambda r: r.first)
    return segments, np.array([r.first for r in ended], np.int64), np.array([capacities[bisect.bisect_left(capacities, r.used)] for r in ended], np.int32)


def _pieces(most: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            n = np.concatenate([np.diff(words(data[off[a] : off[b]], off[a : b + 1] - off[a])[2]) + 1 for a, b in pieces(off)] or [np.zeros(0, np.int64)])
            parts = -(-n // most)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * most
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(np.minimum(most, n[row] - start), pa.int32())], schema=schema)

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, piece, start (first token), length, bin_id, bin_capacity, bin_offset of every piece of every row."""
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(plain.mapInArrow(_pieces(max(capacities)), "doc_id long, piece int, start long, length int").withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    segments, first_bin, capacity = best_fit(histogram, capacities)
    # lengths of many pieces are ranked in shares, dealt by row number: repeated rows and null ids are no hot key
    most = max(1, min(RANK_ROWS, sum(histogram.values()) // RANK_PARTS))
    shares = [(n, 1 + c // most) for n, c in histogram.items() if c >= most]
    shares = F.broadcast(rows.sparkSession.createDataFrame(shares, "length int, shares int"))  # a row a length at most
    salted = rows.join(shares, "length", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("shares", F.lit(1))).cast("int"))
    sums = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")) - 1
    ranked = salted.withColumn("own", own).join(small(before), ["length", "salt"]).select("doc_id", "piece", "start", "length", (F.col("own") + F.col("before")).alias("rank"))
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 6)
    key = table[:, 0] << 40 | table[:, 1]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("bin_id", pa.int64()), ("bin_capacity", pa.int32()), ("bin_offset", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
            s = table[np.searchsorted(key, length << 40 | rank, "right") - 1]
            r = rank - s[:, 1]
            bin_id = s[:, 2] + r // s[:, 3]
            size = capacity[np.searchsorted(first_bin, bin_id, "right") - 1]
            yield pa.record_batch([*(batch.column(x) for x in range(4)), pa.array(bin_id), pa.array(size, pa.int32()), pa.array(s[:, 4] + r % s[:, 3] * length, pa.int32())], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length int, bin_id long, bin_capacity int, bin_offset int")
