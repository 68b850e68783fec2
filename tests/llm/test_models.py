import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeflow.llm import common, html as H, lm, quality as Q, sharding, toxicity as T


def brute_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if not at:
        return []
    i, j = at
    return [x for x in brute_segments(scores[:i])] + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_maximal_segments():
    for seed in range(200):
        r = random.Random(seed)
        scores = [r.choice([-0.25, -0.25, -0.25, r.uniform(0.1, 2), -r.uniform(0.5, 3)]) for _ in range(r.randint(0, 25))]
        at = np.array([i for i, s in enumerate(scores) if s != -0.25], int)
        got = T.segments(at, np.array([scores[i] for i in at]), 0.25)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_take_linear_time():
    """Separated hits of rising and of falling size, which a rescan of all candidates takes quadratic time for."""
    import time

    def seconds(n, gain):
        at = np.arange(n) * 9
        t = time.process_time()
        T.segments(at, np.array([gain(i) for i in range(n)]), 0.25)
        return time.process_time() - t

    for gain in (lambda i: 1.0, lambda i: 1 + i * 1e-4, lambda i: 10 - i * 1e-4):
        assert min(seconds(64_000, gain) for _ in range(3)) < 0.5


def test_a_long_toxic_text(labelled, make):
    docs, labels = labelled
    model = T.fit(docs, labels)
    (r,) = T.score(make([(1, " ".join(["vile plain words and more of them here"] * 40_000))]), model).collect()
    assert r["predicted"] == 1 and r["n_passages"] >= 1


@pytest.fixture(scope="module")
def labelled(spark, make, prose):
    docs, labels = [], []
    for i in range(400):
        w = prose(40, i).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for bad in ("vile", "scoundrel", "vile"):
                w.insert(i % 30, bad + random.Random(i).choice(["", ",", "!"]))
        text = " ".join(w[:20]) + ".\n" + " ".join(w[20:]) + "."
        if not good:
            text = " ".join(x + "$$$" for x in text.upper().split(" "))
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(3, None, None), (None, 1, 1), (10_000, 1, 0), (4, 1, 1)]
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled, odd):
    docs, labels = labelled
    rows = T.toxicity(docs, labels).collect()
    truth = {i: i % 4 == 0 for i in range(400)}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and held
    assert np.mean([(r["predicted"] == 1) == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    passages = [(text[r["doc_id"]][p["start"] : p["end"]], r["doc_id"]) for r in rows for p in r["passages"]]
    assert passages and np.mean([any(x in p.lower() for x in ("vile", "scoundrel")) for p, _ in passages]) > 0.95
    strange = T.toxicity(odd, labels).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert [r["held_out"] for r in strange if r["doc_id"] is None] == [False, False]
    assert {r["score"] for r in T.toxicity(odd, labels.limit(0)).collect()} == {1 / (1 + math.exp(30))}
    left = T.reject_toxic(docs, labels)
    assert left.schema == docs.schema and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned(labelled, spark):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in T.toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in T.toxicity(docs, turned).collect()}


def test_quality(labelled, odd):
    docs, labels = labelled
    rows = Q.quality(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 3 != 0) for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    strange = Q.quality(odd, labels).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert {r["score"] for r in Q.quality(odd, labels.limit(0)).collect()} == {0.0}
    assert Q.quality(docs.limit(0), labels).count() == 0


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    emit, first, t = r.normal(size=9), np.array([0, 4, 4, 9]), r.normal(size=(2, 2))
    good, expected = Q.marginals(emit, first, t)
    want, edges = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        n, z = b - a, 0.0
        own, e = np.zeros(n), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            p = math.exp(sum(emit[a + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            own += p * np.array(y)
            for i in range(n - 1):
                e[y[i], y[i + 1]] += p
        if n:
            want[a:b] = own / z
            edges += e / z
    assert np.allclose(good, want) and np.allclose(expected, edges)


def test_line_features():
    texts = ["Ab 1!\n\nAb 1!\nx x x", "", "no end", "\n"]
    x, size, first = Q.line_features(*common.flat(pa.array(texts)))
    assert first.tolist() == [0, 4, 5, 6, 8] and size.tolist() == [6, 1, 6, 6, 1, 7, 1, 1]
    assert x[:, 8].tolist() == [0, 0, 1, 0, 0, 0, 0, 0] and np.allclose(x[3, 7], 2 / 3) and np.allclose(x[0, :3], [1 / 5, 1 / 5, 0])


def test_sharding(make, odd, prose):
    docs = make([(i, prose(1 + i % 90, i)) for i in range(600)] + [(1000 + i, "copies of one text") for i in range(400)]).union(odd)
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == docs.count()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    most = max(r["size"] for r in rows)
    mean = sum(size.values()) / 7
    assert all(abs(n - mean) <= most for n in size.values())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(7):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    assert sharding.shard(docs.limit(0), 7).count() == 0


def test_language_model(make, odd, prose):
    docs = make([(i, prose(5 + i % 60, i // 3)) for i in range(150)]).union(odd)
    rows = lm.score_texts(docs).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    given = docs.collect()
    c = Counter(w for r in given if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 4)) for r in given)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    unseen = [r for r in rows if r["held_out"] and r["n_tokens"] < 1000]  # one long text is unlike the others
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) and all(r["score"] < 0 for r in rows)
    assert lm.score_texts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("given", [[(i, "one text for all") for i in range(50)] + [(7, "one text for all")] * 900, [(None, f"{'x' * (i % 3)}") for i in range(900)], [(None, None)] * 700])
def test_sharding_of_repeated_rows(make, given):
    """Keys that no boundary can divide are split by row number."""
    rows = sharding.shard(make(given), 7).collect()
    size, most = Counter(), max(r["size"] for r in rows)
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(rows) == len(given) and all(abs(n - sum(size.values()) / 7) <= most for n in size.values())
    for s in range(7):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_quality_takes_whole_documents_within_the_bound(labelled):
    docs, labels = labelled
    a, b = Q.fit(docs, labels), Q.fit(docs, labels, max_lines=100)
    assert (a.weights != b.weights).any() and Q.fit(docs, labels, max_lines=0) is None
    assert (a.weights == Q.fit(docs, labels, max_lines=10**9).weights).all()


def brute_mixture(rows, held):
    """log10 of the interpolated trigram probability of each text, with dictionaries; n-grams before a text begin with None
    and texts end with an end."""
    grams = lambda t: [(x, y, z) for x, y, z in zip(["<"] * 2 + t, ["<"] + t, t)]
    bucket = lambda c: min(15, math.ceil(math.log2(c + 1)))

    def counts(texts):
        c = [Counter(), Counter(), Counter()]
        for t in texts:
            for x, y, z in grams(t):
                c[0][z] += 1
                c[1][y, z] += 1
                c[2][x, y, z] += 1
        return c, len(texts)

    def parts(c, docs, n, v, g):
        x, y, z = g
        pair = docs if y == "<" else c[1][x, y]
        single = docs if y == "<" else c[0][y]
        return bucket(pair) * 16 + bucket(single), [min(1, c[2][g] / max(pair, 1)), min(1, c[1][y, z] / max(single, 1)), c[0][z] / max(n, 1), 1 / (v + 1)]

    train = [(em, t) for (i, em, t) in rows if not held(i)]
    every, docs = counts([t for _, t in train])
    kept, docs_kept = counts([t for em, t in train if not em])
    n, v, n_kept = sum(every[0].values()), len(every[0]), sum(kept[0].values())
    seen = Counter()
    for em, t in train:
        for g in grams(t) if em else []:
            b, p = parts(kept, docs_kept, n_kept, v, g)
            q = [round(-math.log2(x) / lm.STEP) if x > 0 else -1 for x in p[:3]]
            seen[b, *q] += 1
    w = lm._weights([{"bucket": b, "q3": q3, "q2": q2, "q1": q1, "number": c} for (b, q3, q2, q1), c in seen.items()], n_kept, v)

    def score(t):
        return sum(math.log10(float(w[b] @ np.array(p))) for b, p in (parts(every, docs, n, v, g) for g in grams(t)))

    return [(i, score(t)) for i, _, t in rows]


@pytest.mark.parametrize("row_tokens", [1000, 4])
def test_language_model_against_dictionaries(make, spark, prose, monkeypatch, row_tokens):
    monkeypatch.setattr(lm, "ROW_TOKENS", row_tokens)
    monkeypatch.setattr(lm, "LEAST_CHUNK", 50)
    docs = make([(i, prose(3 + i % 40, i // 2)) for i in range(160)] + [(700, ""), (701, None), (None, prose(9, 3))])
    em = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {lm.HELD}) = 0 as em").collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r["doc_id"], em[r["doc_id"]], (r["text"] or "").split() + [">"]) for r in docs.collect()]
    want = sorted(((i, s) for i, s in brute_mixture(rows, held)), key=lambda x: (x[0] is None, x))
    got = sorted(((r["doc_id"], r["score"]) for r in lm.score_texts(docs).collect()), key=lambda x: (x[0] is None, x))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-6)


def test_rows_of_the_exchange_grow_with_the_corpus():
    rows = []
    for size in (1 << 34, 5 << 34, 1 << 44):
        tokens, most = size / lm.TOKEN_BYTES, lm._chunk_tokens(size)
        rows.append(tokens / most * tokens / (lm.PART_SHARE * most) / tokens)
    assert max(rows) / min(rows) < 1.01


def test_language_model_is_a_distribution():
    """The mixture over all words of a vocabulary and the end adds up to one with the share of unseen words."""
    w = lm._weights([], 10, 4)
    assert np.allclose(w.sum(1), 1)
    seen = [{"bucket": 3, "q3": 0, "q2": 2, "q1": 8, "number": 50}, {"bucket": 3, "q3": -1, "q2": -1, "q1": 10, "number": 1}]
    w = lm._weights(seen, 10, 4)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.8


def test_chunk_round_trip():
    x = np.array([0, 5, 2**33, 2**63], np.uint64)
    assert (lm._unpack(lm._pack(x), 4) == x).all() and (lm._unpack(lm._pack(x[:2]), 2) == x[:2]).all()


def test_html_extraction(spark):
    pages = [
        (1, "u", '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><article><h1>A title here</h1><p>First &amp; long paragraph of the article, with many words in it.<p>Second\n   paragraph&nbsp;goes on and on, with <b>bold</b> words.</article><div class="comments"><div class="comment">Nice text, I liked it.</div></div><footer>&copy; example</footer></body></html>'),
        (2, None, None), (None, "v", ""), (3, "w", "<<<>>> <p"), (3, "w", "<<<>>> <p"),
    ]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, text int")
    rows = H.extract(df).collect()
    assert len(rows) == 5
    (r,) = [r for r in rows if r["page_id"] == 1]
    assert r["text"] == "A title here First & long paragraph of the article, with many words in it. Second paragraph goes on and on, with bold words."
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and [r["text"] for r in rows if r["page_id"] == 2] == [""]
    assert H.extract(df.limit(0)).count() == 0


DIRTY = [
    ("<p>One <img alt=it's> two.</p><p>Three don't stop.</p><p>Four.</p>", ["One two.", "Three don't stop.", "Four."]),
    ('<p class="a>One two.', ["One two."]),
    ('<p class="a>One two.</p><p class="b">Three.</p>', ["One two.", "Three."]),
    ('<p class="a>He said "yes" and left.</p><p>End.</p>', ['He said "yes" and left.', "End."]),
    ("<p title='x>One.</p><p title='y'>Two.</p><div id=z>Three.</div>", ["One.", "Two.", "Three."]),
    ('<p title="a > b">One.</p><p title="<b>x</b>" class=c>Two.</p>', ["One.", "Two."]),
    ('<p title="a"class="b">One.</p><a href=x=\'y\'>link</a> rest', ["One.", "link rest"]),
    ("a < b and c > d <p>x<3</p> <!-- c --> <!-->y<!---->z<![CDATA[ q ]]>", ["a < b and c > d", "x<3", "yz"]),
    ("<p>One<p", ["One"]), ("<p>One <!-- never closed <p>Two", ["One"]), ("<p>One</p", ["One"]), ('One<p a="', ["One"]),
]


@pytest.mark.parametrize("page,want", DIRTY)
def test_dirty_markup(page, want):
    assert [b.text for b in H.blocks(page)] == want


@pytest.mark.parametrize("unit", ['<p class="a>x ', "<p class='a>x ", "<div>", "</section><div>", "<p title='a\">x", "<!-- ", "<p", '<a b="', "<td>", "<p><button>", "<script>", "&amp;<i>"])
def test_blocks_take_linear_time(unit):
    import time

    def seconds(n):
        page = unit * n
        t = time.process_time()
        H.blocks(page)
        return time.process_time() - t

    seconds(100)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.05)
    assert [b.text for b in H.blocks("<p class='a\">end</p>" * 3)] == ["end"] * 3


def test_very_long_and_odd_pages(spark, odd):
    long = "<nav><a href='/'>Home</a></nav><article><h1>A long article</h1>" + "".join(f"<p>Paragraph number {i} of a very long article, with some more words in it.</p>" for i in range(20_000)) + "</article><footer>&copy; example</footer>"
    deep = "<div>" * 20_000 + "<p>Deep down stands a paragraph that has quite a few words to say, and it ends well.</p>"
    pages = odd.selectExpr("doc_id as page_id", "lang as url", "text as html", "a as n_chars").union(spark.createDataFrame([(900, "u", long, 1), (901, None, deep, None)], "page_id long, url string, html string, n_chars int"))
    rows = H.extract(pages).collect()
    assert len(rows) == odd.count() + 2 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    (r,) = [r for r in rows if r["page_id"] == 900]
    assert r["text"].count("Paragraph number") == 20_000 and r["text"].startswith("A long article Paragraph") and "example" not in r["text"]


def test_html_held_out_pages():
    model, good, wrong, all_ = H.default_model(), 0, 0, 0
    for _, blocks, labels in H.training_pages(60, seed=77):
        for b, mine, y in zip(blocks, model.labels(blocks), labels, strict=True):
            all_ += y
            good += mine and y
            wrong += mine and not y
    assert good / all_ > 0.93 and good / (good + wrong) > 0.93


def test_viterbi_is_the_best_labelling():
    model = H.Model({"bias": 0.1, "end True": 0.7, "first": -0.4, "last": -1.0}, np.array([[0.3, -0.6], [-0.2, 0.5]]))
    blocks = [H.Block(("p",), t, 0) for t in ("one.", "two", "three.", "four", "five.")]
    emit = [model.emission(blocks, i) for i in range(5)]
    value = lambda y: sum(e for e, z in zip(emit, y) if z) + sum(model.transitions[y[i], y[i + 1]] for i in range(4))
    best = max(([c >> i & 1 for i in range(5)] for c in range(32)), key=value)
    assert [int(x) for x in model.labels(blocks)] == best
