import math
import random

import numpy as np
import pytest

from tideline.llm import bitslice


def brute(rows, every=100, k=10, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(a))) for a in x]) for i, x in rows if x is not None and all(a is not None and math.isfinite(a) for a in x)]
    kept = [(i, q) for i, q in kept if all(abs(a) < 1 << 62 for a in q)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        held = lambda x: min(max(x, -bitslice.LONGEST - 1), bitslice.LONGEST)
        scores = sorted((-held(sum(x * y for x, y in zip(q, p))), j is None, j or 0) for b, (j, p) in enumerate(kept) if b != a and len(p) == len(q))
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(spark, rows, every=100, block=256, chunk=3, width=bitslice.WIDTH):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, number string").repartition(4)
    q = bitslice.vectors(df, "vec_id", "embedding", bitslice.SCALE)
    out = bitslice.search(bitslice.index(q, block, width), q.filter(f"vec_id % {every} = 0"), chunk=chunk)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()), key=str)


def planted(n, size, rnd):
    rows = [(i, [rnd.gauss(0, 1 / 8) for _ in range(size)]) for i in range(n)]
    rows += [(2000 + i, [0.125] * size) for i in range(n // 3)]  # one vector holds many rows: ties by id
    rows += [(100, rows[100][1]), (100, rows[100][1]), (100, [0.1] * size), (None, rows[100][1]), (None, [0.125] * size), (9000, None), (9100, [float("nan")] * size), (9200, [None] * size), (9300, [float("-inf")] * size), (9400, [3e38] * size), (9500, [1.0] * (size + 1)), (9501, [0.5] * (size + 1)), (9600, []), (9601, [])]
    return rows


@pytest.mark.parametrize("width", [1, bitslice.WIDTH, 12])
def test_equals_all_products(spark, width):
    rows = planted(320, 16, random.Random(5))
    assert found(spark, rows, width=width) == brute(rows)


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e12, -4e9, 0.0]), (1, [1e12, 1.0, 1.0]), (2, [-1e12, 5.0, 0.5]), (3, [4e15, 4e15, 4e15]), (100, [4e15, 4e15, -4e15]), (4, [0.0] * 3), (200, [0.0] * 3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, [1.0])]) == [] == found(spark, [(0, [1.0])])


def test_slices_bound_the_scores_and_select_few():
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(5000, 64))
    q = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    block = bitslice.Block.of(np.arange(5000), np.ones(5000, bool), q)
    resolved = 0
    for query in q[:20].tolist():
        lowest, sums, base, off = block.coarse(query)
        coarse = sum(np.unpackbits(s.view(np.uint8), bitorder="little", count=5000).astype(np.int64) << i for i, s in enumerate(sums))
        exact = q @ np.array(query)
        assert (np.abs(exact - (coarse * 2.0**lowest + base)) <= off).all()
        assert block.kth(sums, 10) == sorted(coarse)[-10]
        for least in (0, 1, int(coarse.max()), int(coarse.max()) + 1, 1 << 60):
            assert (bitslice.unpacked(block.at_least(sums, least), 5000) == np.flatnonzero(coarse >= least)).all()
        order = np.lexsort((np.arange(5000), -exact))[:10]
        assert block.search(query, 10) == [(int(exact[i]), False, int(i)) for i in order]
        resolved += int((coarse >= block.kth(sums, 10) - 2 * off / 2.0**lowest).sum())
    assert resolved < 20 * 500  # a tenth of the rows at most: the slices do decide


def test_empty_table(spark):
    assert found(spark, [(7, None)]) == []
