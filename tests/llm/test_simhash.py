import random

import numpy as np
import xxhash

from tideline.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(items):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(items)]


def test_thresholds_keep_the_pigeonhole_sum():
    assert simhash.thresholds([[0, 5, 50, 500], [0, 1, 2, 900], [0, 9, 90, 900]], 2) == [0, 1, -1]
    assert sum(t + 1 for t in simhash.thresholds([[0, 1, 5, 9]] * 3, 2)) == 3
    assert simhash.candidates(10, np.full(64, 0.5), [0], 1, 0.0) == [0.0, 25.0, 50.0]
    assert simhash.candidates(10, np.full(64, 0.5), [0, 1, 2], 1, 7.0) == [0.0, 50 / 8 + 70, 25.0 + 210]


def independent(n, p):
    both = np.outer(p, p) * n
    np.fill_diagonal(both, p * n)
    return both


def test_the_plan_grows_with_the_nodes():
    """Few nodes: three partitions probed exactly. Very many: fewer candidates are worth more probes."""
    p = np.full(64, 0.5)
    plans = {n: simhash.plan(n, independent(n, p), 2) for n in (10**4, 10**7, 10**10, 10**16)}
    assert plans[10**4][1] == [0, 0, 0] and sorted(plans[10**10][1]) == [0, 1] and plans[10**16][1] == [2]
    for cut, limits in plans.values():
        assert sum(t + 1 for t in limits) == 3 and sorted(b for part in cut for b in part) == list(range(64))


def test_lopsided_bits_make_larger_groups():
    p = np.array([0.5] * 32 + [0.02] * 32)
    cut, limits = simhash.plan(10**6, independent(10**6, p), 2)
    sizes = sorted(map(len, cut))
    assert sizes[-1] > sizes[0] + 4 and sum(t + 1 for t in limits) == 3
    # correlated bits come together: the second half copies the first
    both = np.zeros((64, 64))
    for i in range(64):
        for j in range(64):
            both[i, j] = 0.5 if i % 32 == j % 32 else 0.25
    cut = simhash.partitions(100, both * 100, 2)
    assert sum(b + 32 in part for part in cut for b in part if b < 32) >= 30


def test_every_plan_finds_all_links(spark):
    """The same links whatever probes cost, so with one, two and three partitions."""
    rnd = random.Random(8)
    prints = {rnd.getrandbits(64) for _ in range(150)}
    for x in list(prints):
        for k in (1, 2, 3):
            y = x
            for b in rnd.sample(range(64), k):
                y ^= 1 << b
            prints.add(y)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    want = {d: c for d, _, c in brute_components([(v, p) for v, p in zip(signed, sorted(prints))])}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    seen = set()
    for probe in (1e6, 1e-4, 0.0):
        n, together = simhash.bit_counts(nodes)
        seen.add(len(simhash.plan(n, together, 2, probe)[0]))
        root = {r.a: r.b for r in simhash.components(simhash.links(nodes, probe=probe)).collect()}
        assert {v: root.get(v, v) for v in signed} == want
    assert len(seen) >= 2


def test_rows_against_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(rnd.choice([2, 5, 80, 300]))) for _ in range(40)]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "é È"] + base + base[:10]
    for t in base:
        w = t.split()
        w[rnd.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    rows = [(None if i == 9 else i * 7 % 1000, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    want = brute_components([(d, brute_print(t)) for d, t, _ in rows])
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_crowded_keys_are_split_and_lose_no_link(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 500:
        x = centre
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    nodes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    root = {r.a: r.b for r in simhash.components(simhash.links(nodes, group=16)).collect()}
    items = list(prints)
    want = brute_components([(signed[p], p) for p in items])
    assert {d: root.get(d, d) for d, _, _ in want} == {d: c for d, _, c in want}
