import random

import numpy as np
import pyarrow as pa

from codeflow.llm import common, decontam as D


def brute(docs, items, k, least):
    out = {}
    for i, text in docs:
        w = D_words(text)
        for item, t in items:
            v = D_words(t)
            if not v:
                continue
            a = weights(v, k)
            for c in range(len(w) - len(v) + 1):
                like = similarity(a, weights(w[c : c + len(v)], k))
                if like >= least - 1e-12:
                    out[(i, item)] = max(out.get((i, item), 0), round(like, 9))
    return out


def D_words(text):
    data, off = common.flat(pa.array([text], pa.string()))
    s, e, _ = common.words(data, off, common.ALNUM)
    return [bytes(common.LOWER[data[a:b]]) for a, b in zip(s, e)]


def weights(w, k):
    out = {}
    for g in [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)]:
        out[g] = out.get(g, 0) + 1
    return out


def similarity(a, b):
    both = sum(min(n, b.get(g, 0)) for g, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_against_brute_force(spark, make, prose):
    items = [(i, prose(15 + 3 * i, 1000 + i)) for i in range(12)] + [(50, "two words"), (51, ""), (52, None), (53, prose(15, 1000))]
    r = random.Random(1)
    docs = []
    for i in range(60):
        text = prose(30 + i, i).split()
        if i % 2:
            passage = items[i % 12][1].upper().replace(" ", ", ").split(" ")
            if i % 3 == 0:
                passage[0 if i % 4 else len(passage) // 2] = "changed"
            at = r.randrange(len(text))
            text[at:at] = passage
        if i == 7:
            text += "and two words".split()
        docs.append((i, " ".join(text)))
    got = {}
    for x in D.contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[x["doc_id"], x["item_id"]] = max(got.get((x["doc_id"], x["item_id"]), 0), round(x["similarity"], 9))
    assert got == brute(docs, [x for x in items if x[1]], 5, 0.8)
    left = {x["doc_id"] for x in D.drop_contaminated(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}


def test_spans_and_odd_rows(spark, make, odd, prose):
    item = prose(20, 77)
    docs = make([(100, f"ünd {item} énd"), (None, item)]).union(odd)
    bench = spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string")
    rows = D.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in rows) == [(-1, 1), (100, 1)]
    (r,) = [r for r in rows if r["doc_id"] == 100]
    assert f"ünd {item} énd"[r["start"] : r["end"]] == item
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench).count() == docs.count() - 2 and D.drop_contaminated(docs, bench).schema == docs.schema


def shingles(w):
    data, off = common.flat(pa.array([" ".join(w)]))
    starts, ends, first = common.words(data, off, common.ALNUM)
    return common.shingle_hashes(common.word_hashes(data, starts, ends), first, 5)[0]


def flipped(r, a, n):
    b = a.copy()
    b[r.choice(D.BITS, n, replace=False)] ^= 1
    return b


def test_blocks_find_all_within_the_radius_and_few_others(prose):
    """Items of a benchmark as fingerprints: all within the radius come back, under a fifth of the others are looked at."""
    r = np.random.default_rng(0)
    index = D.build([(i, prose(30, i)) for i in range(3000)], 5)
    prints = np.unpackbits(index.prints, axis=1)
    looked = []
    for i in range(60):
        x = flipped(r, prints[i], D.RADIUS - i % 3)
        found, differ = index.tables.within(x)
        assert i in found and set(found) == set(np.flatnonzero((prints != x).sum(1) <= D.RADIUS)) and max(differ) <= D.RADIUS
        looked.append(len(index.tables.candidates(r.integers(0, 2, D.BITS).astype(np.uint8))) / 3000)
    assert np.mean(looked) < 0.2


def test_radius_holds_windows_at_the_least_similarity(prose):
    """The share of windows of similarity 0.8 or little more that the fingerprints find, against exact comparison."""
    found = 0
    for i in range(300):
        w = prose(60, i).split()
        v = w.copy()
        for j in (7, 40) if i % 2 else (20,):
            v[j] = "changed"
        a, b = (shingles(t) for t in (w, v))
        found += int((D.fingerprint(a) != D.fingerprint(b)).sum()) <= D.RADIUS
    assert found / 300 >= 0.99


def test_every_occurrence_is_reported(spark, make, prose):
    item, other = prose(30, 1), prose(30, 2)
    text = " ".join([item, prose(10, 3), item.upper(), other, item])
    rows = D.contaminated(make([(1, text)]), spark.createDataFrame([(7, item), (8, other)], "item_id long, text string")).collect()
    assert sorted((r["item_id"], text[r["start"] : r["end"]].lower()) for r in rows) == [(7, item)] * 3 + [(8, other)]
    # of windows that overlap, the best counts
    (r,) = D.contaminated(make([(1, "x " + " ".join(item.split()[:29]) + " y z")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert r["similarity"] < 1


def test_ties_between_windows(spark, make):
    """A text of one word repeated: every window is like the item; the first ones that do not overlap are reported."""
    rows = D.contaminated(make([(1, "go " * 50)]), spark.createDataFrame([(3, "go " * 12)], "item_id long, text string")).collect()
    assert sorted(r["start"] for r in rows) == [0, 36, 72, 108] and {r["similarity"] for r in rows} == {1.0}


def test_several_passes(spark, make, prose, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_A_PASS", 2)
    bench = spark.createDataFrame([(i, prose(20, 500 + i)) for i in range(5)], "item_id long, text string")
    docs = make([(i, "x y z " + prose(20, 500 + i)) for i in range(5)] + [(9, prose(80, 9))])
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()) == [(i, i) for i in range(5)]
    assert [r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()] == [9]


def brute_whole(docs, items, k, least):
    """The whole text against the items that have more words."""
    like = {(i, item): round(similarity(weights(D_words(t), k), weights(D_words(text), k)), 9) for i, text in docs for item, t in items if len(D_words(t)) > len(D_words(text)) > 0}
    return {x: n for x, n in like.items() if n >= least - 1e-12}


def test_documents_shorter_than_an_item(spark, make, prose):
    items = [(i, prose(n, 3000 + i)) for i, n in enumerate([60, 50, 20, 9, 10, 6, 40, 60])] + [(8, "one two"), (9, " ".join(["same words again"] * 12)), (10, prose(60, 3000))]
    docs = []
    for _, text in items:
        w = text.split()
        for n in range(1, len(w)):
            docs += [w[n:], w[:-n], w[n // 2 : len(w) - (n + 1) // 2]]
        docs += [w[: len(w) // 2] + w[len(w) // 2 + 1 :], w[: len(w) // 2] + ["changed"] + w[len(w) // 2 + 2 :]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = brute(docs, items, 5, 0.8) | brute_whole(docs, items, 5, 0.8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(make(docs), bench).collect()
    assert {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in rows} == want and len(rows) == len(want)
    assert {0, 1, 4, 9, 10} <= {item for _, item in brute_whole(docs, items, 5, 0.8)}
    assert all((x["start"], x["end"]) == (0, len(docs[x["doc_id"]][1])) for x in rows if len(D_words(docs[x["doc_id"]][1])) < len(D_words(items[x["item_id"]][1])))
    assert {x["doc_id"] for x in D.drop_contaminated(make(docs), bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_one_word_cut_off_or_deleted(spark, make, prose):
    a, b = prose(60, 4000), prose(50, 4001).split()
    docs = make([(1, a.rsplit(" ", 1)[0]), (2, " ".join(b[:25] + b[26:])), (3, prose(59, 4002))])
    bench = spark.createDataFrame([(1, a), (2, " ".join(b))], "item_id long, text string")
    assert sorted((x["doc_id"], x["item_id"], round(x["similarity"], 2)) for x in D.contaminated(docs, bench).collect()) == [(1, 1, 0.98), (2, 2, 0.82)]
    assert [x["doc_id"] for x in D.drop_contaminated(docs, bench).collect()] == [3]
