import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tideline.llm import quality


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op3_quality_gam(spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    assert len(rows) == pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"]).num_rows
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in rows.items())
    held = [(rows[x["doc_id"]].score, x["quality"]) for x in labels if rows[x["doc_id"]].held_out]
    assert auc(*map(np.array, zip(*held))) > 0.95


def test_model_is_additive_and_deterministic():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert auc(m.score(x), y) > 0.95 and (0, 1) in m.pairs
    assert (m.score(x) == quality.fit(x, y).score(x)).all()
    one = m.intercept + sum(t[np.searchsorted(e, x[0, k], side="right")] for k, (e, t) in enumerate(zip(m.edges, m.tables))) + sum(t[np.searchsorted(m.pair_edges[a], x[0, a], side="right"), np.searchsorted(m.pair_edges[b], x[0, b], side="right")] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(x[:1])[0] - 1 / (1 + np.exp(-one))) < 1e-12


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 1), (1, "fine words here", 1), (2, None, 1), (3, "", 1), (None, "x" * 100000, 1), (4, "### $$$ ***", 1)], "doc_id long, text string, score int")
    some = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    for labels in (some, some.limit(0), some.filter("quality = 1")):
        model = quality.train(docs, labels)
        got = quality.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def plain_features(text):
    """The features in loops over characters and words."""
    words = text.split()
    if not words:
        return [0.0] * 16
    raw, n = text.encode(), len(words)
    lines = text.split("\n")
    count = lambda chars: sum(c in chars for c in text)
    low = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words]
    pairs = {(a, b) for a, b in zip(low, low[1:])}
    return [
        np.log(len(raw)), np.log(n), len(raw) / n, np.log(max(len(w.encode()) for w in words)), sum("A" <= c <= "Z" for c in text) / len(raw), count("0123456789") / len(raw), count("#$%&*@^~<>{}[]\\=+_") / n, count("!") / n,
        count(".") / n, count("|") / n, len(set(low)) / n**0.75, len(set(lines)) / len(lines), np.log(n / len(lines)), 1 - len(text) / len(raw), sum(w.encode() in quality.FUNCTION_WORDS for w in low) / n, len(pairs) / max(1, n - 1),
    ]


def test_features_in_plain_code():
    texts = ["", " \n", "One", "The cat. The CAT!\nThe cat | 42", "é È ü the und", "a" * 300, "x y " * 50 + "\n" * 3 + "#$ 1"]
    texts += [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if r and not any(c in r for c in "\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000")][:60]
    for t in texts:
        assert quality.features(t.encode()) == pytest.approx(plain_features(t), rel=1e-12, abs=1e-12), t[:50]


def plain_tree(rows, depth):
    """Steps of a tree by bin, from rows (bin, gradient, curvature): the cut of most gain, tried one by one."""
    bins = sorted({b for b, _, _ in rows})
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, cut = 1e-9, None
    for at in range(1, max(bins) + 1) if depth and bins else ():
        left, right = [r for r in rows if r[0] < at], [r for r in rows if r[0] >= at]
        hl, hr = sum(r[2] for r in left), sum(r[2] for r in right)
        if hl >= 2 and hr >= 2:
            gain = sum(r[1] for r in left) ** 2 / (hl + 1) + sum(r[1] for r in right) ** 2 / (hr + 1) - g * g / (h + 1)
            if gain > best + 1e-12:
                best, cut = gain, at
    if cut is None:
        return lambda b: g / (h + 1)
    low, high = plain_tree([r for r in rows if r[0] < cut], depth - 1), plain_tree([r for r in rows if r[0] >= cut], depth - 1)
    return lambda b: low(b) if b < cut else high(b)


def test_boosting_rounds_in_plain_code():
    """Two cyclic rounds over three features, row by row: the same tables' sums as the vectorised fit."""
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 6, (150, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (rnd.random(150) < 0.2)).astype(float)
    model = quality.fit(x, y, rounds=2, bins=16, pairs=0, pair_rounds=0)
    p = (y.sum() + 1) / (len(y) + 2)
    total = [float(np.log(p / (1 - p)))] * len(y)
    for _ in range(2):
        for k in range(3):
            at = [sum(v >= e for e in model.edges[k]) for v in x[:, k]]
            q = [1 / (1 + np.exp(-t)) for t in total]
            step = plain_tree([(b, t - v, v * (1 - v)) for b, t, v in zip(at, y, q)], 2)
            total = [t + 0.1 * step(b) for t, b in zip(total, at)]
    assert model.score(x) == pytest.approx([1 / (1 + np.exp(-t)) for t in total], abs=1e-9)


def plain_cut(rows, axis, bins):
    """The best cut along an axis of rows (a, b, gradient, curvature), tried one by one; a cut that leaves too little counts 0."""
    g, h = sum(r[2] for r in rows), sum(r[3] for r in rows)
    found = []
    for at in range(1, bins):
        left, right = [r for r in rows if r[axis] < at], [r for r in rows if r[axis] >= at]
        hl, hr = sum(r[3] for r in left), sum(r[3] for r in right)
        gain = sum(r[2] for r in left) ** 2 / (hl + 1) + sum(r[2] for r in right) ** 2 / (hr + 1) - g * g / (h + 1)
        found.append((gain if hl >= 2 and hr >= 2 else 0.0, -at))
    gain, at = max(found, default=(0.0, 0))
    return gain, -at


def plain_pair_tree(rows, shape):
    """Gain, and the step of a cell, of the better of the two trees that cut one axis and then each side along the other."""
    mean = lambda some: sum(r[2] for r in some) / (sum(r[3] for r in some) + 1)
    best = 0.0, lambda a, b: mean(rows)
    for axis in (0, 1):
        gain, cut = plain_cut(rows, axis, shape[axis])
        if gain <= 1e-9:
            continue
        leaves = {}
        for low in (True, False):
            side = [r for r in rows if (r[axis] < cut) == low]
            more, other = plain_cut(side, 1 - axis, shape[1 - axis])
            gain += more
            halves = [[r for r in side if r[1 - axis] < other], [r for r in side if r[1 - axis] >= other]] if more > 1e-9 else [side, side]
            leaves[low] = other, mean(halves[0]), mean(halves[1])

        def step(a, b, axis=axis, cut=cut, leaves=leaves):
            one, two = (a, b) if axis == 0 else (b, a)
            other, low, high = leaves[one < cut]
            return low if two < other else high

        if gain > best[0]:
            best = gain, step
    return best


def test_pairs_in_plain_code():
    """Choice of pairs and two cyclic rounds over them, row by row, behind one round over the features; then whole scores."""
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 5, (220, 4)).astype(float)
    y = (((x[:, 0] > 2) ^ (x[:, 2] > 1)) ^ (rnd.random(220) < 0.1)).astype(float)
    model = quality.fit(x, y, rounds=1, bins=16, pair_bins=5, pairs=2, pair_rounds=2)
    p = (y.sum() + 1) / (len(y) + 2)
    total = [float(np.log(p / (1 - p)))] * len(y)
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    for k in range(4):
        at = [sum(v >= e for e in model.edges[k]) for v in x[:, k]]
        q = [sigmoid(t) for t in total]
        step = plain_tree([(b, t - v, v * (1 - v)) for b, t, v in zip(at, y, q)], 2)
        total = [t + 0.1 * step(b) for t, b in zip(total, at)]
    edges = [sorted({float(np.quantile(x[:, k], i / 5)) for i in range(1, 5)}) for k in range(4)]
    at = [[sum(v >= e for e in edges[k]) for v in x[:, k]] for k in range(4)]
    shape = lambda a, b: (len(edges[a]) + 1, len(edges[b]) + 1)
    rows = lambda a, b: [(i, j, t - sigmoid(s), sigmoid(s) * (1 - sigmoid(s))) for i, j, t, s in zip(at[a], at[b], y, total)]
    gains = sorted((-plain_pair_tree(rows(a, b), shape(a, b))[0], a, b) for a in range(4) for b in range(a + 1, 4))
    pairs = [(a, b) for _, a, b in gains[:2]]
    assert model.pairs == pairs and (0, 2) in pairs
    for _ in range(2):
        for a, b in pairs:
            step = plain_pair_tree(rows(a, b), shape(a, b))[1]
            total = [t + 0.1 * step(i, j) for t, i, j in zip(total, at[a], at[b])]
    assert model.score(x) == pytest.approx([sigmoid(t) for t in total], abs=1e-9)
