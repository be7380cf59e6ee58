import hashlib
import math
import random

import numpy as np
import pytest

from tideline.llm import centroids


def brute(rows, k, rounds, scale, size, seed):
    """Plain Lloyd with Python's whole numbers: every vector against every centroid, every round."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(a is not None and math.isfinite(a) for a in x):
            q = [math.floor(scale * float(np.float32(a))) for a in x]
            if all(abs(a) < 1 << 62 for a in q):
                kept.append((i, q))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [list(q) for _, q in sorted(kept, key=key)[:k]]
    d = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    owner = lambda q: min((d(q, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [owner(q)[1] for _, q in kept]
        for j in range(len(centres)):
            own = [q for (_, q), o in zip(kept, of) if o == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i, owner(q)[1], min(owner(q)[0], centroids.LONGEST)) for i, q in kept), key=str), centres


def planted(n, size, rnd):
    middles = [[rnd.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i, [a + rnd.gauss(0, 0.2) for a in rnd.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, [0.25] * size) for i in range(n // 3)]  # one vector holds many rows
    rows += [(5, rows[5][1]), (5, [0.0] * size), (None, [0.5] * size), (None, [0.5] * size), (7000, None), (7001, []), (7002, [1.0] * (size + 1)), (7003, [float("nan")] + [0.0] * (size - 1)), (7004, [float("inf")] + [0.0] * (size - 1)), (7005, [None] + [0.0] * (size - 1)), (7006, [3e38] + [0.0] * (size - 1))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, cluster string, q int").repartition(5)


@pytest.mark.parametrize("large", [False, True])
def test_equals_plain_lloyd(spark, large):
    rows = planted(120, 6, random.Random(3))
    if large:
        rows += [(8000, [40000.0, -3.0, 1e9, 0.0, 0.0, 2.0]), (8001, [-1e9] * 6), (8002, [2e9] * 6)]
    want, centres = brute(rows, 9, 4, 256, 6, 2)
    table, found = centroids.cluster(frame(spark, rows), k=9, rounds=4, components=6)
    assert found == centres
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in table.collect()), key=str) == want


def test_only_what_changed_is_compared():
    rnd = np.random.default_rng(1)
    q = rnd.integers(-200, 200, (400, 8))
    centres = rnd.integers(-200, 200, (7, 8)).tolist()
    own, distance = centroids.nearest(q, np.full(400, -1), np.zeros(400, np.int64), centres, list(range(7)))
    moved = [list(c) for c in centres]
    moved[2] = [0] * 8
    moved[5] = moved[2]  # a tie: the smaller number
    seen = []
    real = centroids.squared
    centroids.squared = lambda a, c: seen.append((len(a), len(c))) or real(a, c)
    try:
        got = centroids.nearest(q, own, distance, moved, [2, 5])
    finally:
        centroids.squared = real
    want = centroids.nearest(q, np.full(400, -1), np.zeros(400, np.int64), moved, list(range(7)))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and not (got[0] == 5).any()
    owners = int(np.isin(own, [2, 5]).sum())
    assert seen == [(owners, 7), (400 - owners, 2)]


def test_transfers_are_signed_sums(spark):
    rows = spark.createDataFrame([([1, 2], -1, 0), ([1 << 61, 5], 0, 1), ([1 << 61, 5], 0, 1), ([3, 3], 1, 0)], "q array<long>, was int, cluster int")
    got = {(r.cluster, r.component): int(r.total) for r in centroids.transfers(rows).collect()}
    assert got == {(0, -1): 0, (0, 0): 4 - (1 << 62), (0, 1): -5, (1, -1): 1, (1, 0): (1 << 62) - 3, (1, 1): 7}


def test_few_and_no_vectors(spark):
    table, centres = centroids.cluster(frame(spark, [(1, [0.5] * 4), (2, [0.1] * 4), (3, None)]), k=9, components=4)
    assert len(centres) == 2 and sorted(r.distance for r in table.collect()) == [0, 0]
    table, centres = centroids.cluster(frame(spark, [(3, None)]), k=9, components=4)
    assert centres == [] and table.count() == 0


def test_query_of_no_vectors(spark, tmp_path):
    frame(spark, [(1, None)]).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = centroids.op11_centroids(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
