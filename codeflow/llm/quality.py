"""Document quality from line labels of a linear-chain conditional random field.

Every line of a text is good or bad. A line's features are shares of character classes, repetition and layout, of the
line itself and of its neighbours; transitions tie lines that follow each other. The field is trained on the lines of
labelled documents by gradient steps on the exact likelihood. Only documents have labels, so each line takes its
document's, and the transitions learn that lines of a text are alike; which of them are good is told by their features. The forward-backward
marginals of the good label, weighted by line length, give the document's raw quality; a logistic curve fitted on
training documents turns it into the score, moved so that the decision threshold is the point of fewest training errors.

Defined results: null and empty texts are one empty line; a null doc_id is scored and counts as not held out; labels with
a null label or id are not learned from, and of repeated labels of an id the larger counts; without labels of both kinds
every score is 0; repeated rows are scored each; an empty table gives an empty result. Only doc_id and text are read of
the documents, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, flat, held_out, pieces, word_hashes, words
from .toxicity import labelled, logistic

#: Labelled documents to learn from at most (those with the smallest hashes of their ids), and lines of them in all: whole
#: documents are taken, in the order of hashes of their lines, as long as they add up to no more.
MAX_LABELLED, MAX_LINES = 8_000, 400_000
#: Score from which a document counts as good.
THRESHOLD = 0.7
_STEPS, _RATE = 150, 0.1

_CLASS = np.zeros((256, 7), np.float32)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "#$%&*+/<>=@[\\]^_`{}~", "|", "!")):
    _CLASS[[ord(c) for c in _chars], _i] = 1
_CLASS[128:, 6] = 1
#: Features of a line: shares of upper case, digits, punctuation, symbols, bars, exclamation marks and non-ASCII bytes;
#: repeated neighbouring words; a line seen before in the text; words (log), mean word length, bytes (log); full stop at
#: the end; empty.
FEATURES = 14


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their bytes plus one, and the number of each row's first line (one entry more)."""
    # lines end at line feeds and at row ends; rows are laid out with a line feed after each
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    text = np.full(len(data) + n, 10, np.uint8)
    text[np.arange(len(data)) + row] = data
    ends = np.flatnonzero(text == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(ends, np.concatenate([[0], off[1:] + np.arange(n)]))
    first[1:] += 1
    size = ends - starts
    wide = np.maximum(size, 1).astype(np.float32)
    out = np.zeros((len(ends), FEATURES), np.float32)
    for c in range(7):
        total = np.concatenate([[0], np.cumsum(_CLASS[text, c], dtype=np.float64)])
        out[:, c] = (total[ends] - total[starts]) / wide
    bounds = np.concatenate([starts, [len(text)]])
    begin, end, word = words(text, bounds)
    h = word_hashes(text, begin, end)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h):
        inside = np.ones(len(h), bool)
        inside[word[:-1][word[:-1] < len(h)]] = False
        same[1:] = np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]) & inside)
    count = np.diff(word)
    out[:, 7] = (same[word[1:]] - same[word[:-1]]) / np.maximum(count, 1)
    total = np.zeros(len(h) + 1, np.uint64)
    place = (np.arange(len(h)) - np.repeat(word[:-1], count)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    np.cumsum(h * place, out=total[1:])
    line = total[word[1:]] - total[word[:-1]]
    of = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((line, of))
    again = np.zeros(len(ends), bool)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (of[order[1:]] == of[order[:-1]]) & (count[order[1:]] > 0)
    out[:, 8] = again
    out[:, 9] = np.log1p(count) / 5
    out[:, 10] = np.minimum(size / np.maximum(count, 1), 40) / 20
    out[:, 11] = np.log1p(size) / 8
    last = text[np.maximum(ends - 1, 0)]
    out[:, 12] = (size > 0) & np.isin(last, [ord(c) for c in ".!?"])
    out[:, 13] = count == 0
    return out, size + 1, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bias, the line's features, and those of the lines before and after it in its text."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge = first[:-1][np.diff(first) > 0]
    before[edge] = 0
    after[first[1:][np.diff(first) > 0] - 1] = 0
    return np.concatenate([np.ones((len(x), 1), np.float32), x, before, after], 1)


@dataclass
class Model:
    weights: np.ndarray  # of the good label against the bad one
    transitions: np.ndarray  # 2 x 2
    bias: float
    slope: float


def marginals(emit: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the good label of every line, and the expected transitions; all texts advance together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], first[:-1][order]
    steps = int(n[0]) if len(n) else 0
    alive = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # texts with more than t lines
    t00, t01, t10, t11 = transitions.ravel()
    a = np.zeros((len(emit), 2))
    for t in range(steps):
        at = start[: alive[t]] + t
        if t:
            p = a[at - 1]
            a[at, 0] = np.logaddexp(p[:, 0] + t00, p[:, 1] + t10)
            a[at, 1] = np.logaddexp(p[:, 0] + t01, p[:, 1] + t11) + emit[at]
        else:
            a[at, 1] = emit[at]
    b, expected = np.zeros((len(emit), 2)), np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[: alive[t]] + t
        q = b[at].copy()
        q[:, 1] += emit[at]
        b[at - 1, 0] = np.logaddexp(t00 + q[:, 0], t01 + q[:, 1])
        b[at - 1, 1] = np.logaddexp(t10 + q[:, 0], t11 + q[:, 1])
        p = a[at - 1]
        z = np.logaddexp(a[at, 0] + b[at, 0], a[at, 1] + b[at, 1])
        for i in range(2):
            for j in range(2):
                expected[i, j] += np.exp(p[:, i] + transitions[i, j] + q[:, j] - z).sum()
    return 1 / (1 + np.exp(np.clip(a[:, 0] + b[:, 0] - a[:, 1] - b[:, 1], -60, 60))), expected


def raw_quality(x: np.ndarray, size: np.ndarray, first: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of the good label of each text."""
    good, _ = marginals(with_neighbours(x, first) @ weights, first, transitions)
    add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first])
    return add(good * size) / np.maximum(add(size.astype(float)), 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat(batch.column(0))
        for a, b in pieces(off):
            x, size, first = line_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            rows = [x[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
            sizes = [size[first[i] : first[i + 1]].tolist() for i in range(b - a)]
            yield pa.record_batch([pa.array(rows, pa.binary()), pa.array(sizes, pa.list_(pa.int64())), batch.column(1).slice(a, b - a).cast(pa.int32())], names=["x", "size", "y"])


def train(x: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the mean log-likelihood of the line labels, then the logistic curve of the document score."""
    label = np.repeat(y.astype(float), np.diff(first))
    wide = with_neighbours(x, first).astype(float)
    same = np.repeat(y, np.maximum(np.diff(first) - 1, 0))
    seen = np.diag([float((same == 0).sum()), float((same == 1).sum())])
    w = np.zeros(wide.shape[1] + 4)
    m, v, n = np.zeros_like(w), np.zeros_like(w), max(len(label), 1)
    for step in range(1, _STEPS + 1):
        good, expected = marginals(wide @ w[:-4], first, w[-4:].reshape(2, 2))
        g = np.concatenate([wide.T @ (label - good), (seen - expected).ravel()]) / n - 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(w[:-4].astype(np.float32), w[-4:].reshape(2, 2), 0.0, 1.0)
    z = _logit(raw_quality(x, size, first, model.weights, model.transitions))
    _, slope = logistic(z, y.astype(float))
    slope = max(slope, 0.05)
    order = np.argsort(z)
    z, y = z[order], y[order].astype(int)
    wrong = np.concatenate([[0], np.cumsum(y)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])  # bad below cut i
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    wrong = np.where(np.concatenate([[True], z[1:] > z[:-1], [True]]), wrong, len(z) + 1)
    best = np.flatnonzero(wrong == wrong.min())
    at = cuts[best[len(best) // 2]]
    model.slope, model.bias = slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * at)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> Model | None:
    """Learn from labelled rows whose crc32(doc_id as text) mod ``modulus`` is not ``remainder``."""
    found = cut(labelled(docs, labels, "quality", modulus, remainder, max_labelled).mapInArrow(_features_of, "x binary, size array<long>, y int").withColumn("order", F.xxhash64("x", "y")))
    sizes = sorted((r["order"], r["n"]) for r in found.select("order", F.size("size").alias("n")).collect())  # two numbers of each labelled row
    within = int(np.searchsorted(np.cumsum([n for _, n in sizes]), max_lines, "right"))
    rows = found.filter(F.col("order") < sizes[within][0]).collect() if within < len(sizes) else found.collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # the order of arrival does not matter
    y = np.array([int(r["y"] == 1) for r in rows])
    if not 0 < y.sum() < len(y):
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows])
    return train(x, np.concatenate([r["size"] for r in rows]), np.concatenate([[0], np.cumsum([len(r["size"]) for r in rows])]), y)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines of every row by a model of the labels outside the held-out remainder."""
    model = fit(docs, labels, modulus, remainder)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            for a, b in pieces(off):
                x, size, first = line_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                score = np.zeros(b - a)
                if model:
                    score = 1 / (1 + np.exp(-np.clip(model.bias + model.slope * _logit(raw_quality(x, size, first, model.weights, model.transitions)), -30, 30)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(score), pa.array(np.diff(first), pa.int32())], schema=schema)

    found = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_lines int")
    return found.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")
