"""Language-model scores by deleted interpolation of n-gram estimates.

The maximum-likelihood trigram, bigram and unigram estimates and a uniform one are mixed with weights that depend on how
often the two contexts occur (buckets of powers of two). A tenth of the training documents is held out of the counts
while the weights are learned on it by expectation maximisation; the model then counts all training documents.

No count table is collected or broadcast. Documents become chunks of word numbers. A chunk asks for each of its distinct
n-grams once, along with how often it holds them; n-grams are dealt by hash, every part adds up all chunks' counts and
answers each chunk in the order it asked. A task holds one chunk or one part. Chunks and parts both grow with the square
root of the corpus, so that the rows exchanged (one for a chunk, a part and an order, of about ``ROW_TOKENS`` tokens) grow
in proportion to it and not with its square. Unigrams are known by 64-bit hashes; longer n-grams by so many bits inside
their part that one in half a million shares its key with another.

Defined results: null and empty texts have one token, the end; a null doc_id counts as not held out; repeated rows count
and are scored each; without training documents N and V are 0; an empty table gives an empty result. Only doc_id and
text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLACK, PIECE_BYTES, bounded, cut, flat, held_out, mix, pieces, word_hashes, words

#: Tokens of a row of the exchange, tokens of a chunk at least, and tokens of a part for each token of a chunk.
ROW_TOKENS, LEAST_CHUNK, PART_SHARE = 1500, 50_000, 0.5
#: Bits of a longer n-gram's key beyond those that number the tokens of a part.
SPARE_BITS = 19
#: Bytes of text that count as a token when chunks are sized.
TOKEN_BYTES = 6
#: One training document in so many is held out while the mixture weights are learned.
HELD = 10
#: Steps of a power of two by which component probabilities are grouped for the expectation maximisation.
STEP = 0.5
_HELD_OUT, _KEPT, _EM = 0, 1, 2
_END, _BEGIN = np.uint64(0x60642E2A34326F15), np.uint64(0x1D8E4E27C47D124F)
_MULT = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BUCKETS = 16
ORDERS = 3


def _pack(x: np.ndarray) -> bytes:
    """Compressed little-endian numbers, bytes of equal weight side by side."""
    wide = np.ascontiguousarray(x.astype(np.uint64 if len(x) and int(x.max()) >> 32 else np.uint32))
    return bytes([wide.itemsize]) + pa.compress(wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(pa.decompress(raw[1:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(np.uint32 if size == 4 else np.uint64).ravel().astype(np.uint64)


_CHUNKS = pa.schema([("chunk", pa.int64()), ("em", pa.bool_()), ("trained", pa.int64()), ("tokens", pa.int64()), ("types", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("roles", pa.list_(pa.int32())), ("vocab", pa.binary()), ("ids", pa.binary())])
_CHUNKS_SQL = "chunk long, em boolean, trained long, tokens long, types long, doc_ids array<long>, lens array<long>, roles array<int>, vocab binary, ids binary"


def _chunk_tokens(size: int) -> int:
    """Tokens of a chunk for a corpus of so many bytes: chunks x parts is then the number of tokens over ROW_TOKENS."""
    return max(LEAST_CHUNK, int((size / TOKEN_BYTES * ROW_TOKENS / PART_SHARE) ** 0.5))


def _chunks(most: int):
    """Chunks of about ``most`` tokens, over the batches of a task; a longer text is a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        held: dict[bool, list[tuple]] = {False: [], True: []}  # (ids, roles, tokens of each text, words)
        size = {False: 0, True: 0}

        def chunk(em: bool) -> pa.RecordBatch:
            nonlocal number
            parts, held[em], size[em] = held[em], [], 0
            lens, roles = np.concatenate([p[2] for p in parts]), np.concatenate([p[1] for p in parts])
            seq, last = np.full(int(lens.sum()), _END), np.zeros(int(lens.sum()), bool)
            last[np.cumsum(lens) - 1] = True
            seq[~last] = np.concatenate([p[3] for p in parts])
            vocab, ids = np.unique(seq, return_inverse=True)
            number += 1
            return pa.record_batch([[task << 32 | number], [em], [int(lens[roles != _HELD_OUT].sum())], [len(seq)], [len(vocab)], [[i for p in parts for i in p[0]]], [lens.tolist()], [roles.tolist()], [_pack(np.diff(vocab, prepend=np.uint64(0)))], [_pack(ids)]], schema=_CHUNKS)

        for batch in batches:
            data, off = flat(batch.column(1))
            role = np.asarray(batch.column(2))
            for a, b in pieces(off, min(PIECE_BYTES, most * TOKEN_BYTES)):  # hashing needs several numbers a byte
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, ends, first = words(own, at, BLACK)
                h, n = word_hashes(own, starts, ends), np.diff(first)
                for em in (False, True):
                    mine = (role[a:b] == _EM) == em
                    if mine.any():
                        ids = batch.column(0).slice(a, b - a).filter(pa.array(mine)).to_pylist()
                        held[em].append((ids, role[a:b][mine], n[mine] + 1, h[np.repeat(mine, n)]))
                        size[em] += int((n[mine] + 1).sum())
                        if size[em] >= most:
                            yield chunk(em)
        yield from (chunk(em) for em in (False, True) if held[em])

    return run


class Chunk:
    """The tokens of a chunk again, and its distinct n-grams of each order in rising order of their keys."""

    def __init__(self, row: dict, parts: int, part_tokens: int):
        self.lens = np.array(row["lens"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        vocab = np.cumsum(_unpack(row["vocab"], row["types"]), dtype=np.uint64)
        w = vocab[_unpack(row["ids"], row["tokens"]).astype(np.int64)]
        one = self.shifted(w, 1, _BEGIN)
        self.trained = np.repeat(np.array(row["roles"]) != _HELD_OUT, self.lens)
        bits = min(64, SPARE_BITS + part_tokens.bit_length() + max(1, (parts - 1).bit_length()))
        self.bits = [64, bits, bits]
        grams = [w, mix(one * _MULT[0] + w * _MULT[1]), mix(self.shifted(w, 2, _BEGIN) * _MULT[2] + one * _MULT[0] + w * _MULT[1] + np.uint64(1))]
        self.keys, self.back = zip(*(np.unique(g >> np.uint64(64 - bits), return_inverse=True) for g, bits in zip(grams, self.bits, strict=True)), strict=True)

    def shifted(self, x: np.ndarray, by: int, fill) -> np.ndarray:
        """The value ``by`` tokens before in the same text, else ``fill``."""
        out = np.empty_like(x)
        out[by:] = x[:-by] if by else x
        for j in range(by):
            at = self.first + j
            out[at[self.lens > j]] = fill
        return out

    def cuts(self, order: int, parts: int) -> np.ndarray:
        """Where the keys of each part begin."""
        bounds = np.array([(p << self.bits[order]) // parts for p in range(parts)], np.uint64)
        return np.concatenate([np.searchsorted(self.keys[order], bounds), [len(self.keys[order])]])


def _requests(parts: int, part_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("ord", pa.int32()), ("chunk", pa.int64()), ("em", pa.bool_()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk, rows = Chunk(row, parts, part_tokens), []
                for o in range(ORDERS):
                    keys, at = chunk.keys[o], chunk.cuts(o, parts)
                    counts = np.bincount(chunk.back[o], chunk.trained, len(keys)).astype(np.uint64)
                    for p in range(parts):
                        if at[p] < at[p + 1]:
                            own = keys[at[p] : at[p + 1]]
                            rows.append((p, o, row["chunk"], row["em"], len(own), _pack(np.diff(own, prepend=np.uint64((p << chunk.bits[o]) // parts))), _pack(counts[at[p] : at[p + 1]])))
                yield pa.record_batch([pa.array([r[j] for r in rows], schema.types[j]) for j in range(7)], schema=schema)

    return run, "part int, ord int, chunk long, em boolean, n long, keys binary, counts binary"


_ANSWERS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("ord", pa.int32()), ("n", pa.int64()), ("every", pa.binary()), ("kept", pa.binary()), ("types", pa.int64())])


def _answers(group: pa.Table) -> pa.Table:
    """Adds up one part of the n-grams of one order and answers every chunk."""
    n = group.column("n").to_pylist()
    em, at = group.column("em").to_pylist(), np.concatenate([[0], np.cumsum(n)])
    keys = np.concatenate([np.cumsum(_unpack(k.as_py(), m), dtype=np.uint64) for k, m in zip(group.column("keys"), n, strict=True)])
    counts = np.concatenate([_unpack(c.as_py(), m) for c, m in zip(group.column("counts"), n, strict=True)]).astype(float)
    unique, back = np.unique(keys, return_inverse=True)
    every = np.bincount(back, counts, len(unique)).astype(np.uint64)
    kept = np.bincount(back, counts * np.repeat(~np.array(em, bool), n), len(unique)).astype(np.uint64)
    types = [int((every > 0).sum())] + [0] * (len(n) - 1)
    own = [back[at[i] : at[i + 1]] for i in range(len(n))]
    return pa.table([group.column("chunk"), group.column("part"), group.column("ord"), group.column("n"), pa.array([_pack(every[x]) for x in own], pa.binary()), pa.array([_pack(kept[x]) if e else None for x, e in zip(own, em, strict=True)], pa.binary()), pa.array(types, pa.int64())], schema=_ANSWERS)


def _counts_of(chunk: Chunk, answers: list[dict], column: str) -> list[np.ndarray]:
    """How often each token's n-gram of every order occurs."""
    out = []
    for o in range(ORDERS):
        mine = sorted((a for a in answers if a["ord"] == o), key=lambda a: a["part"])
        out.append(np.concatenate([_unpack(a[column], a["n"]) for a in mine])[chunk.back[o]].astype(np.int64))
    return out


def _components(chunk: Chunk, counts: list[np.ndarray], docs: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token's contexts, and its four component probabilities."""
    one, two, three = counts
    pair, single = chunk.shifted(two, 1, docs), chunk.shifted(one, 1, docs)
    bucket = lambda c: np.minimum(np.ceil(np.log2(c + 1.0)).astype(np.int64), _BUCKETS - 1)
    p = np.stack([three / np.maximum(pair, 1), two / np.maximum(single, 1), one / max(n, 1), np.full(len(one), 1 / (v + 1))], 1)
    return bucket(pair) * _BUCKETS + bucket(single), np.minimum(p, 1)


def _weights(seen: list, n: int, v: int) -> np.ndarray:
    """Mixture weights of each bucket by expectation maximisation on grouped held-out tokens; rare buckets lean on the
    weights of all."""
    w = np.full((_BUCKETS * _BUCKETS, 4), 0.25)
    if not seen:
        return w
    bucket = np.array([r["bucket"] for r in seen])
    number = np.array([r["number"] for r in seen], float)
    q = np.array([[r["q3"], r["q2"], r["q1"]] for r in seen], float)
    p = np.concatenate([np.where(q < 0, 0.0, 2.0 ** (-q * STEP)), np.full((len(q), 1), 1 / (v + 1))], 1)
    overall = np.full(4, 0.25)
    for _ in range(60):
        share = p * overall
        share *= (number / np.maximum(share.sum(1), 1e-300))[:, None]
        overall = share.sum(0) / number.sum()
    w[:] = overall
    for _ in range(60):
        share = p * w[bucket]
        share *= (number / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, share[:, j], len(w)) for j in range(4)], 1) + 10 * overall
        w = new / new.sum(1, keepdims=True)
    return np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum(1, keepdims=True)


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows whose
    crc32(doc_id as text) mod ``modulus`` is not ``remainder``."""
    out = held_out("doc_id", modulus, remainder)
    role = F.when(out, _HELD_OUT).when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, _EM).otherwise(_KEPT).cast("int")
    plain = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    most = _chunk_tokens(int(plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0))
    chunks = cut(plain.select("doc_id", "text", role.alias("role")).mapInArrow(_chunks(most), _CHUNKS_SQL))
    sums = chunks.agg(F.sum("trained"), F.sum("tokens"), F.sum(F.when(~F.col("em"), F.col("trained")))).first()
    n, tokens, n_kept = (int(x or 0) for x in sums)
    parts = max(1, -(-tokens // max(1, int(PART_SHARE * most))))
    part_tokens = max(1, int(PART_SHARE * most))
    ask, ask_sql = _requests(parts, part_tokens)
    answers = chunks.select("chunk", "em", "tokens", "types", "lens", "roles", "vocab", "ids").mapInArrow(ask, ask_sql).groupBy("part", "ord").applyInArrow(_answers, "chunk long, part int, ord int, n long, every binary, kept binary, types long")
    answers = cut(answers)
    v = int(answers.filter("ord = 0").agg(F.sum("types")).first()[0] or 0)
    trained = F.aggregate("roles", F.lit(0), lambda a, r: a + F.when(r != _HELD_OUT, 1).otherwise(0))
    ends = chunks.agg(F.sum(trained), F.sum(F.when(~F.col("em"), trained))).first()
    docs_all, docs_kept = int(ends[0] or 0), int(ends[1] or 0)

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("q3", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("number", pa.int64())])
        if not left.num_rows:
            return schema.empty_table()
        chunk = Chunk(left.to_pylist()[0], parts, part_tokens)
        bucket, p = _components(chunk, _counts_of(chunk, right.to_pylist(), "kept"), docs_kept, n_kept, v)
        with np.errstate(divide="ignore"):
            q = np.where(p[:, :3] > 0, np.rint(-np.log2(np.maximum(p[:, :3], 1e-300)) / STEP), -1).astype(np.int64)
        rows, number = np.unique(np.stack([bucket, *q.T], 1), axis=0, return_counts=True)
        return pa.table([*(pa.array(rows[:, j], pa.int32()) for j in range(4)), pa.array(number, pa.int64())], schema=schema)

    of_em = chunks.filter("em")
    seen = of_em.groupBy("chunk").cogroup(answers.filter("kept is not null").groupBy("chunk")).applyInArrow(held, "bucket int, q3 int, q2 int, q1 int, number long")
    weights = _weights(seen.groupBy("bucket", "q3", "q2", "q1").agg(F.sum("number").alias("number")).collect(), n_kept, v)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        chunk = Chunk(row, parts, part_tokens)
        counts = _counts_of(chunk, right.to_pylist(), "every")
        bucket, p = _components(chunk, counts, docs_all, n, v)
        add = lambda x: np.add.reduceat(x, chunk.first)
        base = np.log10((counts[0] + 1) / (n + 1 * (v + 1)))
        mixed = np.log10(np.einsum("ij,ij->i", p, weights[bucket]))
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array([r == _HELD_OUT for r in row["roles"]]), pa.array(chunk.lens), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(chunk.lens), n)), pa.array(add(base)), pa.array(add(mixed))], schema=schema)

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "part", "ord", "n", "every").groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
