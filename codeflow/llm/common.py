"""Shared pieces: cutting lineage, size-checked broadcasts, and vectorised tokenising of Arrow text columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast, and their bytes; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of text that the Python side works on at once.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python at most (a longer row is a batch of its own).
BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is set, a local master gets a temporary one, and
    any other is an error: executors of several machines don't share a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="codeflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: lineage ends there."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/codeflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows and, at ``row_bytes`` each, at most BROADCAST_BYTES;
    else as it is (the join then shuffles)."""
    most = min(most, BROADCAST_BYTES // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joined(rows: DataFrame, table: DataFrame, on: list[str], size: str, how: str = "inner", hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; its column ``size`` says how many rows have the key, and goes). Keys of
    more than ``hot`` rows, of which there are few, are joined by broadcast, so that no task gets all rows of a key."""
    all_, few, rest = table.drop(size), table.filter(F.col(size) > hot), table.filter(F.col(size) <= hot)
    if (whole := small(all_, row_bytes=256)) is not all_:
        return rows.join(whole, on, how)
    heads = few.drop(size)
    if few.isEmpty() or (hinted := small(heads, row_bytes=256)) is heads:
        return rows.join(all_, on, how)
    return rows.join(hinted, on).unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(rest.drop(size), on, how))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Arrow batches of BATCH_BYTES at most, so that the memory of a Python worker
    does not depend on the length of the texts. A smaller setting stays. (Plans run when their results are asked for, so the
    setting can't be taken back here.)"""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def crc(col: str | Column) -> Column:
    """Unsigned CRC-32 of the column as text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


def held_out(col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) has this remainder; a null id counts as not held out."""
    return F.coalesce(F.pmod(crc(col), F.lit(modulus)) == remainder, F.lit(False))


# ---------------------------------------------------------------- Arrow text columns

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words by white space only.
BLACK = ~_WS
#: Bytes of words of letters and digits (all bytes of non-ASCII characters count as letters).
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins (one entry more); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = BLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in bytes, and the number of the first word of each row (one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_in = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, is_in[:-1]
    after[-1], after[:-1] = False, is_in[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 4096)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = np.uint64(1)
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased), the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    terms = (LOWER[data] if lower else data).astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


_PLACES = [np.uint64(pow(int(_BASE), 2 * j + 1, 1 << 64) ^ 0x5BD1E995 << 8 | 1) for j in range(64)]


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row (a row of fewer words: its whole sequence), and where each row's
    begin; rows without words have none."""
    n, m = np.diff(first), len(h)
    at = np.concatenate([[0], np.cumsum(np.where(n >= k, n - k + 1, n > 0))])
    runs = np.zeros(0, np.uint64)
    if m >= k:  # over all rows at once; runs that reach over the end of a row are left out afterwards
        runs = h[: m - k + 1] * _PLACES[0]
        for j in range(1, k):
            runs += h[j : m - k + 1 + j] * _PLACES[j]
        inside = np.ones(len(runs), bool)
        for j in range(1, k):
            over = first[1:] - j
            inside[over[(over >= 0) & (over < len(runs))]] = False
        runs = mix(runs[inside] + np.uint64(k))
    brief = np.flatnonzero((n > 0) & (n < k))
    if not len(brief):
        return runs, at
    out, rest = np.empty(at[-1], np.uint64), np.ones(at[-1], bool)
    rest[at[brief]] = False
    out[rest] = runs
    whole = n[brief].astype(np.uint64)
    for j in range(k - 1):
        has = n[brief] > j
        whole[has] += h[first[brief[has]] + j] * _PLACES[j]
    out[at[brief]] = mix(whole)
    return out, at


def code_points(data: np.ndarray, a: int, b: int) -> int:
    """Characters in a range of UTF-8 bytes."""
    return int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))


def lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    """values at the asked keys (``keys`` sorted), else ``default``."""
    if not len(keys):
        return np.full(len(asked), default, values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)
