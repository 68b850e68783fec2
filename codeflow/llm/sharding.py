"""Shards of near equal bytes by sampled splitters.

Rows are keyed by the CRC-32 of their text and a hash of their id, so equal texts lie side by side and a large group of
them can still be divided. A size-weighted sample of keys gives quantile boundaries of many ranges; ranges that hold too
many bytes are sampled again and subdivided, and those of a single key (repeated rows, null ids) are split by row number.
Exact sums of the ranges then give every row its place in the order of all
bytes, and equal parts of that order are the shards: no shard is off the mean by more than one row.

Defined results: a null text has size 16 and the CRC of the empty text; a null doc_id is a key of its own; repeated rows
take a place each; an empty table gives an empty result. Only doc_id and text are read, so further columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix

#: Ranges for each shard at least, rows of a range to aim at, samples for each range.
RANGES_A_SHARD, RANGE_ROWS, OVERSAMPLE = 16, 250_000, 8
#: A range of more than so many times the mean size is subdivided; rounds at most (each divides by OVERSAMPLE or more).
OVERFULL, ROUNDS = 2.0, 12


def _sampled(df: DataFrame, seed: int, rate) -> np.ndarray:
    """Sorted keys of the rows kept with probability ``rate``; about as many as the caller's rates add up to."""
    u = F.pmod(F.xxhash64("key", "row", F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return np.sort(np.array([r[0] for r in df.filter(u < rate).select("key").collect()], np.int64))


def _ranged(keyed: DataFrame, bounds: np.ndarray, splits: dict[int, int] | None = None) -> DataFrame:
    """With the range of each row, and its share of a range that is split."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("range", pa.int32()), ("share", pa.int32())])
    shares = np.ones(len(bounds) + 1, np.int64)
    for k, n in (splits or {}).items():
        shares[k] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(3).to_numpy(), "right").astype(np.int32)
            share = (mix(batch.column(4).to_numpy().view(np.uint64)) % shares[at].astype(np.uint64)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(at), pa.array(share)], schema=schema)

    return keyed.mapInArrow(run, "doc_id long, size long, text_crc32 long, key long, row long, range int, share int")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0), grown_shard (null) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    keyed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), crc.alias("text_crc32"), F.shiftleft(crc, 30).bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).alias("key"), F.monotonically_increasing_id().alias("row")))
    rows, total = (int(x or 0) for x in keyed.agg(F.count(F.lit(1)), F.sum("size")).first())
    ranges = max(shards * RANGES_A_SHARD, rows // RANGE_ROWS)
    mean = max(total / ranges, 1.0)
    bounds = np.unique(_sampled(keyed, 1, F.col("size") * (OVERSAMPLE / mean))[OVERSAMPLE - 1 :: OVERSAMPLE])
    for seed in range(2, 2 + ROUNDS):
        ranged = _ranged(keyed, bounds)
        sums = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
        over = {k: n for k, n in sums.items() if n > OVERFULL * mean}
        if not over:
            break
        samples = _sampled(ranged.filter(F.col("range").isin(list(over))), seed, F.col("size") * (OVERSAMPLE / mean))
        new = np.unique(np.concatenate([bounds, *(samples[a:b][OVERSAMPLE - 1 :: OVERSAMPLE] for a, b in ((np.searchsorted(samples, bounds[k - 1] if k else -1, "left"), np.searchsorted(samples, bounds[k], "left") if k < len(bounds) else len(samples)) for k in over))]))
        if len(new) == len(bounds):
            break  # the same keys again: what is still overfull is of a single key, or nearly so
        bounds = new
    sums = {r["range"]: r["size"] for r in _ranged(keyed, bounds).groupBy("range").agg(F.sum("size").alias("size")).collect()}
    splits = {k: int(n // mean) + 1 for k, n in sums.items() if n > OVERFULL * mean}
    placed = _ranged(keyed, bounds, splits)
    sums = placed.groupBy("range", "share").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    base, at, number = [], 0, 0
    for r in sorted(sums, key=lambda r: (r["range"], r["share"])):
        base.append((r["range"], r["share"], at, number))
        at, number = at + r["size"], number + r["n"]
    bases = F.broadcast(keyed.sparkSession.createDataFrame(base, "range int, share int, bytes_before long, rows_before long"))  # as many rows as ranges
    order = Window.partitionBy("range", "share").orderBy("key", "doc_id", "row")
    placed = placed.withColumn("running", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("own", F.row_number().over(order)).join(bases, ["range", "share"])
    middle = 2 * (F.col("bytes_before") + F.col("running")) - F.col("size")
    placed = cut(placed.select("doc_id", "size", "text_crc32", F.expr("own + rows_before - 1").alias("place"), (middle * shards).alias("middle")).withColumn("shard", F.expr(f"middle div {max(2 * total, 1)}L").cast("int")).drop("middle"))
    firsts = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("place")).collect()}
    first = F.element_at(F.array(*(F.lit(firsts[i]).cast("long") for i in range(shards))), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
