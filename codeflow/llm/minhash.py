"""Near-duplicate classes by circulant MinHash: one initial permutation of the shingles, one second permutation whose
circular shifts give every coordinate of the signature, banding, and exact Jaccard verification on full sets.

Defined results: a text that is null or holds no word has the empty set (0 shingles) and is linked with nothing; fewer
than ``k`` words make one shingle of the whole sequence; rows that share a doc_id are one node, whatever their texts, which
are all compared; a null doc_id has a null component and is not kept; repeated rows come back as often as they were given; an empty table gives an empty result.
Only ``id_col`` and ``text_col`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLACK, bounded, cut, flat, joined, mix, pieces, shingle_hashes, small, word_hashes, words

#: Size of the circle of positions on which the second permutation is shifted.
CIRCLE = 1 << 20
#: Rows of a bucket up to which its open pairs are listed; larger ones are compared block by block.
SMALL_BUCKET = 8
#: Pairs that are held against one copy of their leader's text.
PAIRS_A_GROUP = 128
#: Texts and shingles of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 400_000
#: Bits of the filter of shared band keys: 8 to 16 a key, at most 2^29 (64 MB); with more keys it lets more others through.
FILTER_BITS, FILTER_PART = 1 << 29, 1 << 22
#: Rows to a band, and bands: a pair at similarity 0.8 is missed with probability (1 - 0.8^6)^56 = 4e-8.
ROWS, BANDS = 6, 56


@lru_cache(2)
def _windows(coordinates: int) -> np.ndarray:
    """Row i: the values of position i under the second permutation and its first shifts."""
    circle = np.random.default_rng(20).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least value over the set under the second permutation shifted k times."""
    windows, out = _windows(coordinates), None
    # the first permutation: a 64-bit bijection, of which the circle takes the upper bits
    at = (mix(shingles ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(44)).astype(np.int64)
    for a in range(0, len(at), 2048):
        least = windows[at[a : a + 2048]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for a, b in pieces(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = words(part, at, BLACK)
        h, begin = shingle_hashes(word_hashes(part, starts, ends), first, k)
        for i in range(b - a):
            yield np.unique(h[begin[i] : begin[i + 1]])


def _digest(k: int, rows: int, bands: int):
    out = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            data, off = flat(batch.column(1))
            n, s1, s2, keys = [], [], [], []
            for s in _sets(data, off, k):
                n.append(len(s))
                s1.append(int(mix(s).sum(dtype=np.uint64)))
                s2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                if len(s):
                    sig = signature(s, rows * bands).astype(np.uint64).reshape(bands, rows)
                    keys.append(mix((sig * weights).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            lens = np.cumsum([0, *map(len, keys)])
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))],
                schema=out,
            )

    return run


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys with two probes a key, made in parts of FILTER_PART bits."""
    bits = min(FILTER_BITS, 1 << max(16, (8 * keys.count()).bit_length()))
    part = min(bits, FILTER_PART)
    probes = F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))
    out = pa.schema([("part", pa.int64()), ("bits", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        at, on = group.column("at").to_numpy(), np.zeros(part, bool)
        on[at % part] = True
        return pa.table([pa.array([int(at[0]) // part]), pa.array([np.packbits(on, bitorder="little").tobytes()])], schema=out)

    placed = keys.select(F.explode(probes).alias("at")).groupBy(F.floor(F.col("at") / part).alias("p")).applyInArrow(run, "part long, bits binary")
    all_ = np.zeros(bits // 8, np.uint8)
    for r in placed.toLocalIterator():
        all_[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return all_


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(rep, t, n, key) of the band keys that several classes have, and a few others: most keys stand alone, so that first
    the bare keys are counted, and only rows that pass a filter of the shared ones are dealt by key with what they carry."""
    shared = cut(classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"))
    sent = classes.sparkSession.sparkContext.broadcast(_key_filter(shared))
    out = pa.schema([(c, pa.int64()) for c in ("rep", "t", "n", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        mask = np.uint64(8 * len(filter_) - 1)
        for batch in batches:
            lists = batch.column(3)
            key, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            on = np.ones(len(key), bool)
            for at in (key.view(np.uint64) & mask, (key.view(np.uint64) >> np.uint64(32)) & mask):
                on &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows[on])) for i in range(3)), pa.array(key[on])], schema=out)

    return classes.select("rep", "t", F.col("n_shingles").alias("n"), "bands").mapInArrow(run, "rep long, t long, n long, key long")


def _verifier(k: int, percent: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text = list(zip(ids[0], batch.column(4).to_pylist(), strict=True))
            again = np.array([i > 0 and text[i] == text[i - 1] for i in range(len(text))], bool)
            left = batch.column(2).filter(pa.array(~again)) if len(again) else batch.column(2)  # a leader's text stands once for its run of pairs
            lefts, rights = _sets(*flat(left), k), _sets(*flat(batch.column(3)), k)
            a, b, x = [], [], None
            for i, y in enumerate(rights):
                x = x if again[i] else next(lefts)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(ids[0][i])
                    b.append(ids[1][i])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """Those of the pairs (a, t_a, b, t_b) whose full shingle sets reach the similarity. ``docs``: doc_id, t (which names
    the text), text; ``repeated``: rows can have the same id and text."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.join(small(ids), "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "t"]) if repeated else texts
    right = texts.select(F.col("doc_id").alias("b"), F.col("t").alias("t_b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("t").alias("t_a"), F.col("text").alias("text_a"))
    # a leader of many pairs stands in several groups of them
    many = cut(pairs.groupBy("a", "t_a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_GROUP).cast("int").alias("groups")).filter("groups > 1"))
    if not many.isEmpty():
        many = small(many)
        pairs = pairs.join(many, ["a", "t_a"], "left").withColumn("g", F.pmod(F.xxhash64("b", "t_b"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
        left = left.join(many, ["a", "t_a"], "left").withColumn("g", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))).drop("groups")
    both = pairs.join(right, ["b", "t_b"]).join(left, [c for c in ("a", "t_a", "g") if c in pairs.columns]).select("a", "b", "text_a", "text_b", "t_a")
    return both.mapInArrow(_verifier(k, percent), "a long, b long")


def _block_links(k: int, percent: int):
    """Links between different components of two blocks (or inside one), by products of their 0/1 shingle matrices."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rep, comp, left = (group.column(x).to_numpy() for x in ("rep", "c", "is_left"))
        sets = list(_sets(*flat(group.column("text")), k))
        size = np.array([len(x) for x in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        _, column, df = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        column, row = column[shared], row[shared]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        number = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        one = bool(left.all())
        x, y = np.flatnonzero(left), np.flatnonzero(left if one else ~left)
        both = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            a, b = np.searchsorted(number, [low, low + 4096])
            matrix = np.zeros((len(sets), 4096), np.float32)
            matrix[row[a:b], number[a:b] - low] = 1
            both += matrix[x] @ matrix[y].T
        n = both.astype(np.int64)
        i, j = np.nonzero((100 * n >= percent * (size[x][:, None] + size[y][None, :] - n)) & (comp[x][:, None] != comp[y][None, :]) & (n > 0))
        a, b = rep[x[i]], rep[y[j]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    return run


def _links_in_large(docs: DataFrame, large: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """Links between components in the large buckets (key, rows, rep, t, n, c): classes that share such a bucket, directly
    or through others, form a family; it is dealt into blocks of bounded size, and each pair of blocks is one group."""
    low = cut(large.groupBy("key").agg(F.min("rep").alias("a"), F.max("rows").alias("size")))
    family = components(joined(large.drop("rows"), low, ["key"], "size").select("a", F.col("rep").alias("b")))
    members = cut(large.groupBy("rep", "t").agg(F.max("n").alias("n"), F.first("c").alias("c")).join(family, F.col("rep") == F.col("node"), "left").select("rep", "t", "n", "c", F.coalesce("component", "rep").alias("family")))
    number = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    dealt = members.join(number, "family").withColumn("own", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    texts = docs.join(small(members.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    texts = texts.dropDuplicates(["rep", "t"]) if repeated else texts
    rows = texts.join(dealt, ["rep", "t"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "c", (F.col("own") <= F.col("other")).alias("is_left"), "text")
    return rows.groupBy("family", "i", "j").applyInArrow(_block_links(k, percent), "a long, b long")


def _then(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels whose components were joined further by ``more`` (both: node, component; least nodes are left out)."""
    on = more.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return labels.join(on, "component", "left").select("node", F.coalesce("further", "component").alias("component")).union(more)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (a, b) that are not the least of their component. In each round every
    node hangs under its least smaller neighbour, the trees are flattened by pointer jumping, and the links contract to
    their roots; links inside a tree are gone then, so a star takes one round. Each round is written to the shared
    checkpoint folder."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        parent, moving = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))), True
        while moving:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("higher"))
            jumped = cut(parent.join(small(up), "component", "left").select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved")))
            parent, moving = jumped.select("node", "component"), not jumped.filter("moved").isEmpty()
        labels = parent if labels is None else cut(_then(labels, parent))
        edges = _contracted(edges, parent)
    return labels


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between different components, as links between their least nodes."""
    a, b = small(labels.select(F.col("node").alias("a"), F.col("component").alias("x"))), small(labels.select(F.col("node").alias("b"), F.col("component").alias("y")))
    ends = links.join(b, "b", "left").withColumn("y", F.coalesce("y", "b")).filter("y != a").join(a, "a", "left").select(F.coalesce("x", "a").alias("x"), "y")
    return cut(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: link texts with 100 * intersection >= percent * union.

    Equal sets form a class of which the smallest id stands for all. In every bucket the class with the smallest id is
    held against all others (as many pairs as rows). Once these links are joined, only classes of one bucket that are
    still in different components are held against each other: pair by pair in small buckets, block by block in others.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null")
    repeated = not ids.groupBy("doc_id").count().filter("count > 1").isEmpty()
    text = F.col(text_col).cast("string")
    # t names a text among those of an id
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("t"))
    sets = cut(docs.mapInArrow(_digest(k, rows, bands), "doc_id long, t long, n_shingles long, s1 long, s2 long, bands array<long>"))
    one, set_ = docs.filter("doc_id is not null"), ["s1", "s2", "n_shingles"]
    least = lambda *names: F.min(F.struct(*names)) if repeated else F.struct(F.min(names[0]).alias(names[0]), *(F.min_by(n, names[0]).alias(n) for n in names[1:]))
    named = sets.filter("n_shingles > 0").withColumn("known", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    named = named.groupBy(set_).agg(least("known", "t").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), F.count("doc_id").alias("ids"))
    classes = cut(named.filter("ids > 0").select(*set_, F.col("rep.known").alias("rep"), F.col("rep.t").alias("t"), "bands", "copies"))
    keyed = cut(_shared_keys(classes))
    heads = cut(keyed.groupBy("key").agg(least("rep", "t", "n").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    buckets = cut(joined(keyed, heads.select("key", F.col("head.rep").alias("head"), F.col("head.t").alias("head_t"), F.col("head.n").alias("head_n"), "size"), ["key"], "size"))
    stars = buckets.filter("rep != head").groupBy(F.col("head").alias("a"), F.col("head_t").alias("t_a"), F.col("rep").alias("b"), F.col("t").alias("t_b")).agg(F.max("n").alias("n_b"), F.max("head_n").alias("n_a"))
    pairs = cut(stars.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "t_a", "b", "t_b"))
    links = verified(one, pairs, k, percent, repeated)
    if repeated:  # the classes of rows that share an id belong together
        shared = joined(sets.filter("n_shingles > 0 and doc_id is not null").select("doc_id", *set_), classes.select(*set_, "rep", "copies"), set_, "copies")
        links = links.union(shared.filter("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = cut(links)
    label = components(links)
    at = buckets.join(small(label), buckets["rep"] == label["node"], "left").select("key", "rep", "t", "n", "head", "head_t", F.coalesce("component", "rep").alias("c"))
    still = cut(at.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low != high").select("key", "rows", F.col("rows").alias("size")))
    sized = cut(joined(at, still, ["key"], "size"))
    few = sized.filter(F.col("rows") <= SMALL_BUCKET)
    x = few.select("key", "head", "head_t", F.col("rep").alias("a"), F.col("t").alias("t_a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    y = few.select("key", F.col("rep").alias("b"), F.col("t").alias("t_b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
    cross = x.join(y, "key").filter(f"a < b and c_a != c_b and (a != head or t_a != head_t) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "t_a", "b", "t_b").distinct()
    more, large = cut(cross), sized.filter(F.col("rows") > SMALL_BUCKET)
    found = [verified(one, more, k, percent, repeated)] if not more.isEmpty() else []
    if not large.isEmpty():
        found.append(_links_in_large(one, large, k, percent, repeated))
    if found:
        links = found[0] if len(found) == 1 else found[0].union(found[1])
        label = cut(_then(label, components(_contracted(links, label))))
    final = classes.select(*set_, "rep", "copies").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*set_, "copies", F.coalesce("component", "rep").alias("linked"))
    out = joined(sets.filter("n_shingles > 0").select("doc_id", *set_), cut(final), set_, "copies", "left").unionByName(sets.filter("n_shingles = 0").select("doc_id", *set_, F.lit(None).cast("long").alias("linked")))
    if repeated:  # an id of which one row is empty belongs to the component of the others
        own = label.select(F.col("node").alias("doc_id"), "component")
        out = out.join(small(own), "doc_id", "left").withColumn("linked", F.least("linked", "component"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.least("linked", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` of which no smaller id is linked to them, with all their columns; of rows that share an id
    and stay, all stay. A row with a null id stays."""
    found = cut(near_duplicates(docs, **settings))
    gone = cut(found.filter("doc_id is not null and not kept").select("doc_id").distinct())
    name = settings.get("id_col", "doc_id")
    key = f"__gone_{name}"
    return docs.join(small(gone).withColumnRenamed("doc_id", key), F.col(name).cast("long") == F.col(key), "left_anti")
