import random

from codeflow.llm import packing as P


def check(rows, lengths, capacities):
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["length"]
        (size,) = {r["bin_capacity"] for r in own}
        assert size == min(c for c in capacities if c >= at)  # downsized to the contents
    assert sorted(bins) == list(range(len(bins)))
    return bins


def expand(segments, first, capacity):
    rows = []
    for length, _, b, each, offset, n in segments:
        for i in range(n):
            k = b + i // each
            j = max(x for x in range(len(first)) if first[x] <= k)
            rows.append({"length": length, "bin_id": k, "bin_offset": offset + i % each * length, "bin_capacity": int(capacity[j])})
    return rows


def brute_best_fit(lengths, capacities, price=P.cost):
    """One piece at a time in falling order: the open bin with the least room that holds it (of those, the one filled last
    joins the others of its room last); else a bin of the capacity that is cheapest for each token it can be filled with."""
    lengths = sorted(lengths, reverse=True)
    bins = []  # [capacity, used]
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += n
            continue
        best = None
        for c in capacities:
            if c < n:
                continue
            used = n
            for m in lengths[i + 1 :]:
                used += m if used + m <= c else 0
            key = (price(min(x for x in capacities if x >= used)) / used, -c)
            best = min(best, (key, c)) if best else (key, c)
        bins.append([best[1], n])
    return sorted(min(x for x in capacities if x >= used) for _, used in bins), sum(1 for _ in bins)


def test_best_fit_against_one_piece_at_a_time():
    """The rooms and the capacities opened do not depend on which of equal bins takes a piece, so the bins must agree."""
    for seed in range(150):
        r = random.Random(seed)
        capacities = r.choice([(16, 32, 64), (10, 25, 64), (64,), (8, 16, 24, 40, 64)])
        histogram = {r.randint(1, 64): r.randint(1, 6) for _ in range(r.randint(1, 9))}
        histogram = {n: c for n, c in histogram.items() if n <= max(capacities)} or {3: 2}
        _, first, capacity = P.best_fit(histogram, capacities)
        rows = expand(*P.best_fit(histogram, capacities))
        mine = {}
        for x in rows:
            mine.setdefault(x["bin_id"], []).append(x)
        got = sorted(b[0]["bin_capacity"] for b in mine.values())
        assert (got, len(mine)) == brute_best_fit([n for n, c in histogram.items() for _ in range(c)], capacities), (seed, histogram, capacities)


def test_repeated_rows_and_null_ids_are_no_hot_key(make, monkeypatch):
    monkeypatch.setattr(P, "RANK_ROWS", 50)
    rows = P.pack(make([(None, "a b c")] * 400 + [(7, "d e f")] * 400 + [(i, "g h") for i in range(30)]), (16, 32, 64)).collect()
    check(rows, [4] * 800 + [3] * 30, (16, 32, 64))


def test_best_fit_plans():
    for seed in range(40):
        r = random.Random(seed)
        histogram = {r.randint(1, 64): r.randint(1, 30) for _ in range(r.randint(1, 20))}
        rows = expand(*P.best_fit(histogram, (16, 32, 64)))
        bins = check(rows, [n for n, c in histogram.items() for _ in range(c)], (16, 32, 64))
        alone = sum(c * P.cost(next(x for x in (16, 32, 64) if x >= n)) for n, c in histogram.items())
        assert sum(P.cost(b[0]["bin_capacity"]) for b in bins.values()) <= alone  # never dearer than a bin for each piece


def test_ranks_have_no_gaps():
    segments, *_ = P.best_fit({5: 7, 3: 11, 60: 2}, (16, 64))
    for length in (5, 3, 60):
        at = 0
        for s in sorted(s for s in segments if s[0] == length):
            assert s[1] == at
            at += s[5]


def test_documents(make, odd, prose):
    docs = make([(i, prose(n, i)) for i, n in enumerate([1, 5, 30, 63, 64, 65, 200] * 6)] + [(900 + i, "same words here") for i in range(50)]).union(odd)
    rows = P.pack(docs, (16, 32, 64)).collect()
    lengths = []
    for r in docs.collect():
        n = len((r["text"] or "").split()) + 1
        lengths += [64] * (n // 64) + ([n % 64] if n % 64 else [])
    check(rows, lengths, (16, 32, 64))
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 6 and r["length"] > 1)
    assert (0, 0, 64) in pieces and (1, 64, 64) in pieces
    assert P.pack(docs.limit(0)).count() == 0
