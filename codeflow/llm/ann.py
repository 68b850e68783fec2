"""Nearest neighbours by balanced posting lists.

A bounded sample is halved again and again along its main split, so its clusters are balanced; their centroids form the
index in memory, searched over a graph of near centroids. Every vector goes to its nearest list, and, when it lies near a
boundary, to further lists (no two of them nearer to each other than to the vector). A query reads the lists whose centroid
is at most a ratio times as far as the nearest one, up to a number of lists; ratio and number are those at which some sampled
queries find the wanted share of their nearest in the whole index, which one pass over it tells, from the fewest lists. A list of more than ``PART`` vectors is cut again, by centroids of its own, and read by the
same rule. The vectors read are compared with the query, and the best are scored exactly on the original vectors in double
precision. Small lists that lie side by side are compared in one task.

Equal vectors are one entry with its smallest ids, as many as a result can show, so copies of one vector make no list
hot. Defined results: vectors null, empty, zero or holding null or non-finite components and rows with a null id take no
part, as query or as candidate; vectors of different lengths have no cosine, so each length has lists of its own; repeated
rows count once; equal scores are ordered by the smaller id; fewer candidates than asked for are returned all; an empty
table gives an empty result. Only the id and the vector column are read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, small

#: Vectors of the sample that the centroids come from at most, and floats of it at most.
SAMPLE, SAMPLE_FLOATS = 20_000, 2_000_000
#: Distinct vectors for each list to aim at, and lists at most.
LIST_SIZE, MAX_LISTS = 50, 4096
#: Lists that a vector may stand in, and how much farther than the nearest they may be.
REPLICAS, CLOSURE = 4, 1.25
#: Share of the neighbours of sampled queries that the lists read must hold, sampled queries, and lists read at least.
RECALL, PROBES, LEAST_LISTS = 0.95, 256, 8
#: Vectors that a task compares; longer lists are cut into parts of about as many, but into no more than MAX_PARTS by
#: centroids (what is still longer is dealt by hash, and all of it read).
PART, MAX_PARTS = 20_000, 256
_DEGREE, _STEP = 16, 4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(x: np.ndarray, rows: np.ndarray, leaf: float, rng: np.random.Generator) -> list[np.ndarray]:
    if len(rows) <= max(leaf, 1):
        return [rows]
    own = x[rows]
    ends = own[rng.choice(len(rows), 2, replace=False)]
    for _ in range(6):
        along = own @ (ends[0] - ends[1])
        upper = along > np.median(along)
        if upper.all() or not upper.any():
            break
        ends = np.stack([own[upper].mean(0), own[~upper].mean(0)])
    order = np.argsort(own @ (ends[0] - ends[1]), kind="stable")
    middle = len(rows) // 2
    return _halves(x, rows[order[:middle]], leaf, rng) + _halves(x, rows[order[middle:]], leaf, rng)


class Graph:
    """Centroids and, for each, its nearest others; searched best first from a few entries."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = _unit(sample)
        parts = _halves(unit, np.arange(len(unit)), len(unit) / lists, np.random.default_rng(7))
        centre = np.stack([unit[p].mean(0) for p in parts])
        self.centre = (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        k, near = len(self.centre), []
        for a in range(0, k, 1024):
            like = self.centre[a : a + 1024] @ self.centre.T
            like[np.arange(len(like)), a + np.arange(len(like))] = np.inf
            near.append(np.argsort(-like, axis=1, kind="stable")[:, : _DEGREE + 1])
        # each also knows the next on a ring, so that every centroid can be reached
        self.near = np.concatenate([np.concatenate(near), (np.arange(k)[:, None] + 1) % k], 1)
        self.entries = np.unique(np.linspace(0, k - 1, 16).astype(np.int64))  # the halving order spreads them out
        self.ratio, self.beam = math.inf, k

    def calibrate(self, probes: np.ndarray, near: np.ndarray, of: np.ndarray) -> None:
        """Takes the ratio and the number of lists (the nearest ones) within which unit queries ``probes`` find RECALL of
        their neighbours ``near`` (each of the probe ``of``) and read the fewest lists."""
        far = np.maximum(1 - probes @ self.centre.T, 0)
        ratio = far / np.maximum(far.min(axis=1, keepdims=True), 1e-6)
        rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
        lists = list(zip(of.tolist(), self.lists_of(near), strict=True))
        if not lists:
            return
        best, k = (math.inf, math.inf, len(self.centre)), len(self.centre)
        for beam in sorted({min(k, int(LEAST_LISTS * 1.2**i)) for i in range(60)}):
            need = np.sort([np.where(rank[i, own] < beam, ratio[i, own], np.inf).min() for i, own in lists])
            within = float(need[min(len(need) - 1, int(RECALL * len(need)))]) * 1.001
            if math.isfinite(within):
                best = min(best, (float(np.minimum(beam, (ratio <= within).sum(axis=1)).mean()), within, beam))
        _, self.ratio, self.beam = best

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors the lists found, nearest first, and their distances (infinite: not seen). Of the ``beam`` best
        lists of a vector the nearest ones not yet opened are, a few at a time, until all of them have been."""
        n, k = len(x), len(self.centre)
        beam = min(beam, k)
        wide = max(beam, len(self.entries))
        ids, like = np.zeros((n, wide), np.int64), np.full((n, wide), -np.inf, np.float32)
        ids[:, : len(self.entries)], like[:, : len(self.entries)] = self.entries, x @ self.centre[self.entries].T
        closed, seen = ~np.isfinite(like), np.zeros((n, k), bool)
        seen[:, self.entries] = True
        live, step = np.arange(n), min(max(_STEP, beam // 16), wide)
        while len(live):
            best = np.argpartition(np.where(closed[live], np.inf, -like[live]), step - 1, axis=1)[:, :step]
            go = ~np.take_along_axis(closed[live], best, 1)
            some = go.any(1)
            live, best, go = live[some], best[some], go[some]
            if not len(live):
                break
            r, c = np.nonzero(go)
            closed[live[r], best[r, c]] = True
            to = self.near[ids[live[r], best[r, c]]]
            key = np.repeat(r, to.shape[1]) * k + to.ravel()
            key = np.unique(key[~seen[live[key // k], key % k]])
            row, to = key // k, key % k
            seen[live[row], to] = True
            first = np.searchsorted(row, np.arange(len(live) + 1))
            more = int(np.diff(first).max(initial=0))
            if not more:
                continue
            place = np.arange(len(row)) - first[row]
            new_ids, new_like = np.zeros((len(live), more), np.int64), np.full((len(live), more), -np.inf, np.float32)
            new_ids[row, place] = to
            new_like[row, place] = np.einsum("ij,ij->i", x[live[row]], self.centre[to])
            all_like = np.concatenate([like[live], new_like], 1)
            top = np.argpartition(-all_like, wide - 1, axis=1)[:, :wide]
            like[live] = np.take_along_axis(all_like, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], 1), top, 1)
            closed[live] = np.take_along_axis(np.concatenate([closed[live], ~np.isfinite(new_like)], 1), top, 1)
        order = np.argsort(-like, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.maximum(1 - np.take_along_axis(like, order, 1), 0)

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each vector: the nearest and those just beyond a boundary, spread out."""
        out = []
        for a in range(0, len(x), 512):
            order, far = self.search(x[a : a + 512], min(16, len(self.centre)))
            centre = self.centre[order]
            apart = 1 - centre @ centre.transpose(0, 2, 1)
            shut = ~(far <= CLOSURE * far[:, :1])
            rows, last = np.arange(len(order)), np.zeros(len(order), np.int64)
            chosen = np.zeros(order.shape, bool)
            chosen[:, 0] = True
            for _ in range(REPLICAS - 1):  # the next list in order that no chosen one is too near to
                shut |= (apart[rows, last] <= far * 0.8) | (np.arange(order.shape[1]) <= last[:, None])
                last = np.where(shut.all(1), last, np.argmin(shut, axis=1))
                chosen[rows, last] = True
            out += [row[mine].tolist() for row, mine in zip(order, chosen, strict=True)]
        return out

    def lists_for(self, x: np.ndarray) -> list[list[int]]:
        """The lists that each query reads."""
        out = []
        for a in range(0, len(x), 512):
            order, far = self.search(x[a : a + 512], self.beam)
            n = np.maximum(min(LEAST_LISTS, order.shape[1]), (far <= self.ratio * far[:, :1]).sum(axis=1))
            out += [row[:m][np.isfinite(d[:m])].tolist() for row, d, m in zip(order, far, n.tolist(), strict=True)]
        return out


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit rows from a column of vectors of one length."""
    return _unit(np.asarray(col.flatten(), np.float64).reshape(len(col), -1))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Sums rounded once, so equal vectors get equal scores; scaling first keeps squares in range."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0.0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0


def _lists(graphs: dict[int, Graph], col: pa.Array, which: str) -> list[list[int]]:
    """The lists of each vector of a column; all vectors of a length without a graph share one list."""
    sizes = np.diff(col.offsets.to_numpy())
    out = [[0]] * len(col)
    for w in np.unique(sizes).tolist():
        if w in graphs:
            at = np.flatnonzero(sizes == w)
            for a in range(0, len(at), 4096):
                own = at[a : a + 4096]
                for i, lists in zip(own.tolist(), getattr(graphs[w], which)(_matrix(col.take(pa.array(own))).astype(np.float32)), strict=True):
                    out[i] = lists
    return out


def _router(graphs: dict[int, Graph], which: str, keep: list[int]):
    """A row for each vector (second column) and list: its length, the list, and the columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = batch.column(1)
                lists = _lists(graphs, col, which)
                at = pa.array(np.repeat(np.arange(len(lists)), [len(own) for own in lists]))
                sizes = pa.array(np.diff(col.offsets.to_numpy()), pa.int32())
                yield pa.record_batch([sizes.take(at), pa.array([c for own in lists for c in own], pa.int32()), *(batch.column(j).take(at) for j in keep)], names=["w", "list", *(batch.schema.names[j] for j in keep)])

    return run


def _sub_centres(group: pa.Table) -> pa.Table:
    """Centroids of the parts of one long list, from a sample of it."""
    unit, parts = _matrix(group.column("v").combine_chunks()), group.column("parts")[0].as_py()
    halves = _halves(unit, np.arange(len(unit)), len(unit) / parts, np.random.default_rng(7))
    centre = _unit(np.stack([unit[p].mean(0) for p in halves]) + 1e-300)
    return pa.table([group.column("w").slice(0, 1), group.column("list").slice(0, 1), pa.array([centre.ravel().tolist()], pa.list_(pa.float64()))], names=["w", "list", "centres"])


def _part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, list, h, v, part) of vectors with the centroids (last column) of their list."""
    for batch in batches:
        part = [int(np.argmax(np.array(c).reshape(-1, w) @ _unit(np.array([v]))[0])) for w, v, c in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.record_batch([*batch.columns[:4], pa.array(part, pa.int32())], names=["w", "list", "h", "v", "part"])


def _parts_for(ratios: dict[int, float]):
    """(w, list, query_id, own, part) for the parts that a query reads of a long list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, (w, q, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                far = np.maximum(1 - np.array(c).reshape(-1, w) @ _unit(np.array([q]))[0], 0)
                order = np.argsort(far, kind="stable")
                n = max(min(LEAST_LISTS, len(far)), int((far <= ratios.get(w, math.inf) * far.min()).sum()))
                rows += [i] * n
                parts += order[:n].tolist()
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([*(c.take(at) for c in batch.columns[:4]), pa.array(parts, pa.int32())], names=["w", "list", "query_id", "own", "part"])

    return run


def _comparer(wide: int):
    schema = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("h", pa.int64()), ("near", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("q").combine_chunks())
        of, h = left.column("list").to_numpy(), left.column("h").to_numpy()
        asked = right.column("lists").combine_chunks()
        asker, list_ = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
        found = []
        for c in np.unique(of).tolist():
            mine, who = np.flatnonzero(of == c), asker[list_ == c]
            for a in range(0, len(who), 256):
                like = q[who[a : a + 256]] @ x[mine].T
                top = np.argpartition(-like, min(wide, len(mine)) - 1, axis=1)[:, :wide]
                found.append((np.repeat(who[a : a + 256], top.shape[1]), mine[top].ravel(), np.take_along_axis(like, top, 1).ravel()))
        if not found:
            return schema.empty_table()
        i, j, near = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h[j], -near, i))
        i, j, near = i[order], j[order], near[order]
        _, once = np.unique(np.stack([i, h[j]], 1), axis=0, return_index=True)  # a vector can stand in several lists
        once.sort()
        i, j, near = i[once], j[once], near[once]
        best = np.arange(len(i)) - np.searchsorted(i, i) < wide
        i, j, near = i[best], j[best], near[best]
        take = lambda name: right.column(name).combine_chunks().take(pa.array(i))
        return pa.table([take("query_id"), take("own"), pa.array(h[j]), pa.array(near)], schema=schema)

    return run


def _calibrate(index: DataFrame, graphs: dict[int, Graph], sample: dict[int, np.ndarray], k: int) -> None:
    """Holds PROBES queries of the sample against all vectors, and sets each graph's ratio by their nearest."""
    probes = {w: _unit(x[np.unique(np.linspace(0, len(x) - 1, PROBES).astype(np.int64))]) for w, x in sample.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the nearest of each probe so far, and their likeness
        for batch in batches:
            col = batch.column(0)
            sizes = np.diff(col.offsets.to_numpy())
            for w in np.unique(sizes).tolist():
                if w in probes:
                    own = np.flatnonzero(sizes == w)
                    for a in range(0, len(own), 4096):
                        x = _matrix(col.take(pa.array(own[a : a + 4096])))
                        like = probes[w] @ x.T
                        like[like > 1 - 1e-12] = -np.inf  # itself, or one as good
                        top = np.argpartition(-like, min(k, like.shape[1]) - 1, axis=1)[:, :k]
                        near, like = x[top], np.take_along_axis(like, top, 1)
                        if w in best:
                            near, like = np.concatenate([best[w][0], near], 1), np.concatenate([best[w][1], like], 1)
                            top = np.argpartition(-like, min(k, like.shape[1]) - 1, axis=1)[:, :k]
                            near, like = np.take_along_axis(near, top[:, :, None], 1), np.take_along_axis(like, top, 1)
                        best[w] = near, like
        for w, (near, like) in best.items():
            i, j = np.nonzero(np.isfinite(like))
            yield pa.record_batch([pa.array(np.full(len(i), w), pa.int32()), pa.array(i, pa.int32()), pa.array(like[i, j]), pa.array(near[i, j].tolist(), pa.list_(pa.float64()))], names=["w", "probe", "near", "v"])

    found = index.select("v").mapInArrow(run, "w int, probe int, near double, v array<double>")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("w", "probe").orderBy(F.col("near").desc(), "v"))).filter(F.col("n") <= k).collect()  # k rows a probe
    for w, graph in graphs.items():
        mine = sorted((r["probe"], r["n"], r["v"]) for r in found if r["w"] == w)
        if mine:
            graph.calibrate(probes[w].astype(np.float32), np.array([v for *_, v in mine], np.float32), np.array([i for i, *_ in mine]))


def _fitted(index: DataFrame, n: int, k: int) -> dict[int, Graph]:
    """For each length of vectors of the sample its graph; the sample is as many rows as the bounds allow."""
    order = F.xxhash64("h")
    sizes = index.select(order.alias("o"), F.size("v").alias("w")).orderBy("o").limit(SAMPLE).collect()
    within = int(np.searchsorted(np.cumsum([r["w"] for r in sizes]), SAMPLE_FLOATS, "right")) or 1
    rows = index.filter(order <= sizes[min(within, len(sizes)) - 1]["o"]).select("v").limit(SAMPLE).collect() if sizes else []
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: tuple(r["v"][:4])):
        by.setdefault(len(r["v"]), []).append(r["v"])
    sample = {w: np.array(own) for w, own in by.items()}
    graphs = {w: Graph(x, max(1, min(MAX_LISTS, int(n * len(x) / len(rows)) // LIST_SIZE, len(x) // 8))) for w, x in sample.items()}
    _calibrate(index, graphs, sample, k)
    return graphs


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``."""
    rows = cut(_usable(bounded(vectors), id_col, vector_col).withColumn("h", F.xxhash64("v")))
    keep = k + 1
    # the smallest ids of each vector, first within shares of its copies
    first = rows.select("h", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("h", "salt").orderBy("vec_id"))).filter(F.col("n") <= keep)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).filter(F.col("n") <= keep)
    ids = first.groupBy("h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = cut(rows.groupBy("h").agg(F.first("v").alias("v")).join(ids, "h"))
    n, width = index.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    queries = cut(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "h").dropDuplicates(["query_id", "h"]))
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graphs = _fitted(index, n, k)
    postings = cut(index.select("h", "v").mapInArrow(_router(graphs, "lists_of", [0, 1]), "w int, list int, h long, v array<double>"))
    asked = cut(queries.select("query_id", F.col("v").alias("q"), F.col("h").alias("own")).mapInArrow(_router(graphs, "lists_for", [0, 2]), "w int, list int, query_id long, own long"))
    # small lists side by side are one bundle; long ones are cut into parts
    sizes = postings.groupBy("w", "list").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("w").orderBy("list")) - F.col("n")
    plan = cut(sizes.select("w", "list", F.least(F.ceil(F.col("n") / PART), F.lit(MAX_PARTS)).cast("int").alias("parts"), F.when(F.col("n") > PART, -1 - F.col("list")).otherwise(F.floor(before / PART)).cast("int").alias("bundle"), F.ceil(F.col("n") / PART / MAX_PARTS).cast("int").alias("salts")))
    long_ = plan.filter("parts > 1")
    vectors_of, wanted = postings.join(small(plan), ["w", "list"]), asked.join(small(plan), ["w", "list"])
    text = queries.select("query_id", F.col("h").alias("own"), F.col("v").alias("q"))
    text = small(text, row_bytes=8 * width + 64)
    dealt, read = vectors_of.filter("parts = 1").select("w", "list", "h", "v", "bundle", F.lit(0).alias("part"), F.lit(0).alias("salt")), wanted.filter("parts = 1").select("w", "list", "query_id", "own", "bundle", F.lit(0).alias("part"), F.lit(0).alias("salt"))
    if not long_.isEmpty():
        sampled = vectors_of.filter("parts > 1").filter(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(PART)) < F.lit(64))  # about 64 of each part
        one = F.row_number().over(Window.partitionBy("w", "list").orderBy("h"))  # (at least one of each list)
        least = vectors_of.filter("parts > 1").groupBy("w", "list").agg(F.min("h").alias("h"))
        sampled = sampled.select("w", "list", "parts", "h", "v").union(vectors_of.filter("parts > 1").join(least, ["w", "list", "h"]).select("w", "list", "parts", "h", "v"))
        sampled = sampled.withColumn("at", one).filter(F.col("at") <= 64 * MAX_PARTS).drop("at", "h")
        centres = cut(sampled.groupBy("w", "list").applyInArrow(_sub_centres, "w int, list int, centres array<double>"))
        centres = small(centres, row_bytes=8 * width * MAX_PARTS)
        cut_up = vectors_of.filter("parts > 1").select("w", "list", "h", "v").join(centres, ["w", "list"]).select("w", "list", "h", "v", "centres").mapInArrow(_part_of, "w int, list int, h long, v array<double>, part int")
        salts = small(plan.select("w", "list", "bundle", "salts"))
        dealt = dealt.unionByName(cut_up.join(salts, ["w", "list"]).withColumn("salt", F.pmod("h", F.col("salts")).cast("int")).drop("salts"))
        ratios = {w: g.ratio for w, g in graphs.items()}
        some = wanted.filter("parts > 1").select("w", "list", "query_id", "own").join(text, ["query_id", "own"]).join(centres, ["w", "list"]).select("w", "list", "query_id", "own", "q", "centres").mapInArrow(_parts_for(ratios), "w int, list int, query_id long, own long, part int")
        read = read.unionByName(some.join(salts, ["w", "list"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    group, wide = ["w", "bundle", "part", "salt"], keep + 8  # approximate order of the best may differ in the last bits
    read = read.groupBy(*group, "query_id", "own").agg(F.collect_list("list").alias("lists")).join(text, ["query_id", "own"])
    read = read.toDF(*read.columns)  # columns of its own, as both sides come of the same plan table
    near = dealt.groupBy(*group).cogroup(read.groupBy(*group)).applyInArrow(_comparer(wide), "query_id long, own long, h long, near double")
    near = near.groupBy("query_id", "own", "h").agg(F.max("near").alias("near"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("near").desc(), "h"))).filter(F.col("n") <= wide).select("query_id", "own", "h")
    best = near.join(index, "h").join(text, ["query_id", "own"])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b.query_id, "ids": b.ids, "score": [exact_cosine(np.asarray(q, float), np.asarray(v, float)) for q, v in zip(b.q, b.v, strict=True)]}, columns=["query_id", "ids", "score"])

    found = best.select("query_id", "ids", "q", "v").mapInPandas(scored, "query_id long, ids array<long>, score double").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
