import random
import re

import numpy as np

from codeflow.llm import common, minhash as M


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(pairs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in pairs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(make, prose):
    pairs = [(i, prose(40 + i % 50, i)) for i in range(40)]
    pairs += [(100 + i, edited(pairs[i % 5][1], i % 4, i)) for i in range(60)]
    pairs += [(300 + i, pairs[3][1].upper()) for i in range(5)] + [(400, "a b"), (401, "A  b"), (402, "a"), (403, None), (404, ""), (405, None)]
    for k, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(make(pairs), k=k, percent=percent).collect()}
        assert got == {i: (n, c, i == c) for i, (n, c) in brute(pairs, k, percent).items()}


def test_large_buckets(make, prose, monkeypatch):
    """Many near copies of one text that are not all linked with each other: compared block by block."""
    monkeypatch.setattr(M, "SMALL_BUCKET", 2)
    monkeypatch.setattr(M, "BLOCK_TEXTS", 7)
    base = prose(120, 5)
    pairs = [(i, edited(base, i % 9, i)) for i in range(50)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(make(pairs), k=3, percent=85).collect()}
    assert got == brute(pairs, 3, 85)


def brute_rows(rows, k, percent):
    """Components of ids that have several texts: every row is compared, rows of an id are one node."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_ids_with_several_texts(make, prose, monkeypatch):
    text = [prose(50, i) for i in range(12)]
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (3, text[2]), (4, text[2]), (3, text[3]), (5, text[3]), (6, ""), (6, text[4]), (7, text[4]), (8, text[5])]
    rows += [(2, edited(text[6], 1, 1)), (9, text[6]), (10, edited(text[0], 2, 2)), (8, text[5]), (8, text[5]), (11, edited(text[5], 1, 3))]
    rows += [(20 + i, edited(text[7 + i % 3], i % 5, i)) for i in range(30)] + [(20 + i, edited(text[9 + i % 3], i % 4, 90 + i)) for i in range(0, 30, 2)]
    monkeypatch.setattr(M, "PAIRS_A_GROUP", 3)
    for small in (8, 1):
        monkeypatch.setattr(M, "SMALL_BUCKET", small)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in M.near_duplicates(make(rows), k=3, percent=85).collect())
        assert got == brute_rows(rows, 3, 85)


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i) for i in range(3000)] + [(i, i) for i in range(1, 50)], "key long, x long")
    table = spark.createDataFrame([(0, "a", 3000), (1, "b", 1), (60, "c", 0)], "key long, v string, size long")
    for how in ("inner", "left"):
        want = sorted(rows.join(table.drop("size"), "key", how).collect(), key=str)
        for bytes_ in (64 << 20, 600, 1):  # all, the hot keys, and nothing may be broadcast
            monkeypatch.setattr(common, "BROADCAST_BYTES", bytes_)
            assert sorted(common.joined(rows, table, ["key"], "size", how).select("key", "x", "v").collect(), key=str) == want


def test_only_shared_keys_are_dealt(spark, monkeypatch):
    """Of keys that one class has few are left, of the others all; also where the filter has several parts or is too small."""
    r = random.Random(5)
    alone = [[r.randrange(-(1 << 63), 1 << 63) for _ in range(20)] for _ in range(2000)]
    for i in range(600):
        alone[i][0] = alone[i + 600][0]
        alone[i][1] = alone[0][1]
    alone[1999] = []
    df = spark.createDataFrame([(i, 0, 9, b) for i, b in enumerate(alone)], "rep long, t long, n_shingles long, bands array<long>").repartition(3)
    count = {}
    for b in alone:
        for k in b:
            count[k] = count.get(k, 0) + 1
    want = {(i, 0, 9, k) for i, b in enumerate(alone) for k in b if count[k] > 1}
    for bits, part, most in ((1 << 29, 1 << 22, 0.1), (1 << 29, 1 << 10, 0.1), (1 << 10, 1 << 10, 1)):
        monkeypatch.setattr(M, "FILTER_BITS", bits)
        monkeypatch.setattr(M, "FILTER_PART", part)
        got = [tuple(x) for x in M._shared_keys(df).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and len(got) - len(want) <= most * 40_000


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 3), (200, 201), (201, 200)]
    label = {r["node"]: r["component"] for r in M.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert label == {**{i: 1 for i in range(2, 41)}, 101: 100, 102: 100, 201: 200}


def test_odd_rows(odd):
    got = M.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by[1]] == [(0, 1, True)]
    assert [(r["component_id"], r["kept"]) for r in by[7]] == [(7, True)] * 2
    assert all(r["component_id"] is None and not r["kept"] for r in by[None])
    assert M.drop_near_duplicates(odd).count() == odd.count()
    assert M.near_duplicates(odd.limit(0)).count() == 0


def test_signature_is_circulant():
    s = np.arange(50, dtype=np.uint64) * np.uint64(7919)
    sig = M.signature(s, 8)
    w = M._windows(8)
    assert all((w[i][1:] == w[i + 1][:-1]).all() for i in range(100))  # the next position has the values shifted by one
    assert (M.signature(s[:25], 8) >= sig).all()


def test_drop_keeps_columns(make, prose):
    docs = make([(5, prose(30, 1)), (2, prose(30, 1)), (9, prose(30, 3))])
    left = M.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 9]
