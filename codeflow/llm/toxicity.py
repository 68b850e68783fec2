"""Toxic passages by maximum-scoring segment search over token log-odds.

Token log-odds of the two classes with an informative Dirichlet prior give each significant token a score; every other
token costs ``GAP``. A linear scan finds all maximal scoring segments of a text. Under tokens drawn as in clean texts
the best segment of n tokens exceeds S with probability 1 - exp(-K n exp(-lambda S)): lambda comes from the clean token
distribution, K from the best segments of clean training texts. The evidence of a document is the sum over its
significant segments of lambda S - ln(K n); a logistic curve fitted on the training rows turns it into a probability.

Defined results: null and empty texts have no token and get the probability of no evidence; a null doc_id is scored and
counts as not held out; labels without a text, with a null label or a null id are not learned from, and of repeated
labels of an id the larger counts; without any usable label every score is 0; repeated rows are scored each; an empty
table gives an empty result. Only doc_id and text are read of the documents, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, bounded, code_points, cut, flat, held_out, lookup, pieces, small, word_hashes, words

#: Labelled rows to learn from at most (those with the smallest hashes of their ids).
MAX_LABELLED = 40_000
#: z-score from which a token's log-odds count (tokens of so few texts that they can't reach it never get to the driver).
Z = 3.0
#: Pseudo-counts of the Dirichlet prior in all, as a share of the counts.
PRIOR = 0.1
#: Cost of a token that says nothing.
GAP = 0.25
#: Expected number of segments as good by chance, below which a segment is a toxic passage.
E_VALUE = 0.01


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    lam: float
    k: float
    bias: float
    slope: float


def segments(at: np.ndarray, gain: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) of a sequence in which the tokens ``at`` have the scores
    ``gain`` and all others cost ``gap``; linear in the number of scored tokens, as every candidate knows the nearest one
    to its left that begins lower, so that candidates passed over once are never looked at again."""
    found: list[tuple] = []  # first, end, sum before, sum after, place of the nearest candidate that begins lower (or -1)
    total, last = 0.0, -1
    for i, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= gap * (i - last - 1)
        last = i
        before, total = total, total + g
        if g <= 0:
            continue
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, _, before, _, low = found[j]  # it grows to the left over this one and all behind it
            del found[j:]
            j = low
        found.append((first, i + 1, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in found]


def _tokens(data: np.ndarray, off: np.ndarray):
    starts, ends, first = words(data, off, ALNUM)
    return word_hashes(data, starts, ends), starts, ends, first


def _scan(model: Model, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list]]:
    """For each row the number of tokens and its segments (begin byte, end byte, score)."""
    for a, b in pieces(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        h, starts, ends, first = _tokens(part, at)
        s = lookup(model.keys, model.scores, h, 0.0)
        hit = np.flatnonzero(s)
        bound = np.searchsorted(hit, first)
        for i in range(b - a):
            own = hit[bound[i] : bound[i + 1]]
            got = segments(own - first[i], s[own], GAP) if len(own) else []
            yield int(first[i + 1] - first[i]), [(int(starts[first[i] + x] - at[i]), int(ends[first[i] + y - 1] - at[i]), v) for x, y, v in got]


def _evidence(model: Model, n: int, got: list) -> float:
    cost = math.log(max(model.k * max(n, 1), 1e-300))
    return sum(max(0.0, model.lam * v - cost) for _, _, v in got)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat(batch.column(0))
        toxic = np.asarray(batch.column(1), dtype=np.int64)
        for a, b in pieces(off):
            part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
            h, _, _, first = _tokens(part, at)
            # a token counts once in a text, so that one repetitive text does not make a token toxic
            row = np.repeat(np.arange(b - a), np.diff(first))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, label = h[new], toxic[a:b][row[new]] == 1
            keys, back = np.unique(h, return_inverse=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, label, len(keys)).astype(np.int64)), pa.array(np.bincount(back, ~label, len(keys)).astype(np.int64))], names=["h", "y1", "y0"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(text, y) of the ``most`` labelled rows with the smallest hashes whose crc32(doc_id) has not that remainder."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rows = cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(rows), "doc_id").select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope of the most likely logistic curve (a light ridge keeps separable data finite)."""
    w, m = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, m.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod ``modulus`` is not ``remainder``."""
    rows = labelled(docs, labels, "toxic", modulus, remainder, max_labelled)
    counts = cut(rows.mapInArrow(_counts, "h long, y1 long, y0 long").groupBy("h").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    n1, n0 = (int(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, -30.0, 0.0)
    if not n1 or not n0:
        return none
    pseudo = PRIOR * (n1 + n0)
    prior = F.lit(PRIOR) * (F.col("y1") + F.col("y0"))
    odds = F.log((F.col("y1") + prior) / (F.lit(n1 + pseudo) - F.col("y1") - prior)) - F.log((F.col("y0") + prior) / (F.lit(n0 + pseudo) - F.col("y0") - prior))
    z = odds / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    chosen = counts.select("h", "y0", odds.alias("odds"), z.alias("z"), prior.alias("prior")).filter(F.abs("z") >= Z).orderBy("h").toPandas()
    keys = chosen.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    scores = chosen.odds.to_numpy()[order]
    null = ((chosen.y0 + chosen.prior) / (n0 + pseudo)).to_numpy()[order]
    if not (scores > 0).any():
        return none
    # lambda: the positive root of sum p exp(lambda s) = 1 over clean tokens
    rest, low, high = max(0.0, 1 - null.sum()), 1e-6, 1e-6
    excess = lambda x: float((null * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * GAP) - 1)
    if excess(low) > 0:
        lam = 1e-3  # clean texts do not drift downwards: nothing is significant
    else:
        while excess(high) < 0 and high < 100:
            low, high = high, high * 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        lam = low
    model = Model(keys[order], scores, lam, 1.0, 0.0, 0.0)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, [v for *_, v in g]) for n, g in _scan(model, *flat(batch.column(0)))]
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([n for n, _ in got], pa.int64()), pa.array([v for _, v in got], pa.list_(pa.float64()))], names=["y", "n", "all"])

    seen = cut(rows.mapInArrow(maxima, "y int, n long, all array<double>"))
    # the best segments of clean texts, as n exp(-lambda S), are exponential with rate K
    u = seen.filter("y = 0 and n > 0").agg(F.avg(F.col("n") * F.exp(-lam * F.coalesce(F.array_max("all"), F.lit(0.0))))).first()[0]
    model.k = float(min(1.0, max(1e-6, 1 / max(1.0 if u is None else u, 1e-12))))
    price = F.log(F.greatest(F.lit(model.k) * F.greatest("n", F.lit(1)), F.lit(1e-300)))
    evidence = F.aggregate("all", F.lit(0.0), lambda a, v: a + F.greatest(F.lit(0.0), lam * v - price))
    x = seen.select("y", F.log1p(evidence).alias("x")).toPandas().sort_values(["x", "y"])  # two numbers of each labelled row
    model.bias, model.slope = logistic(x.x.to_numpy(), (x.y == 1).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_passages, passages (code points, score, expected number by chance) of every row."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32()),
                     ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            scores, passages = [], []
            for i, (n, got) in enumerate(_scan(model, data, off)):
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * math.log1p(_evidence(model, n, got)))))))
                own, byte, char = [], off[i], 0
                for a, b, v in got:
                    e = model.k * n * math.exp(-model.lam * v)
                    if e <= E_VALUE:
                        start = char + code_points(data, byte, off[i] + a)
                        byte, char = off[i] + b, start + code_points(data, off[i] + a, off[i] + b)
                        own.append({"start": start, "end": char, "score": v, "e_value": e})
                passages.append(own)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, out.field(4).type)], schema=out)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_passages int, passages array<struct<start:bigint,end:bigint,score:double,e_value:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out remainder."""
    found = score(docs, fit(docs, labels, modulus, remainder))
    return found.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted", "n_passages", "passages")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns, without those that the model predicts toxic. Null and empty texts, rows with a
    null id and repeated rows are judged by their text alone; without usable labels, and of an empty table, all rows stay."""
    model, schema, at = fit(docs, labels), docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.bias + model.slope * math.log1p(_evidence(model, n, got)) < 0 for n, got in _scan(model, *flat(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded(docs).mapInArrow(run, schema)


__all__ = ["Model", "fit", "labelled", "logistic", "reject_toxic", "score", "segments", "toxicity"]
