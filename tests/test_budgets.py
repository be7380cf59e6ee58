"""One budget over unlike parts, against plain code."""

import random

from tideline.operators import budgets


def plain(lines, budget, least):
    out = {}
    for key in {r[0] for r in lines}:
        parts = {}
        for k, part, at, line in sorted((r for r in lines if r[0] == key), key=lambda r: r[1:3]):
            parts.setdefault(part, []).append((line or "") + "\n")
        share = {p: min(sum(map(len, t)), least) for p, t in parts.items()}
        left = budget - sum(share.values())
        for p in sorted(parts):
            more = min(left, sum(map(len, parts[p])) - share[p])
            share[p] += more
            left -= more
        text = "".join("".join(parts[p])[: share[p]] for p in sorted(parts))
        out[key] = (text, sum(share[p] > 0 for p in parts))
    return out


def test_bundles_of_unlike_parts(spark):
    rnd = random.Random(6)
    lines = [(k, p, at, rnd.choice(["x", "", None, "é" * rnd.randrange(90), "word " * rnd.randrange(40)])) for k in range(12) for p in range(rnd.randrange(1, 16)) for at in rnd.sample(range(0, 5_000_000_000, 999), rnd.randrange(1, 12))]
    lines += [(99, 3, at * 700, "many rows") for at in range(4000)] + [(99, 1, 1, "first"), (99, 9, 1, "y" * 500)]
    df = spark.createDataFrame(lines, "key long, part int, at long, line string").repartition(5)
    for budget, least in ((600, 40), (90, 6), (100_000, 0)):
        got = {r.key: (r.text, r.n_parts) for r in budgets.bundles(df, "key", "part", "at", "line", budget, least).collect()}
        assert got == plain(lines, budget, least) and all(len(t) <= budget for t, _ in got.values())
    assert budgets.bundles(df.limit(0), "key", "part", "at", "line", 10, 0).count() == 0


def test_ordinary_and_crowded_keys_are_alike(spark):
    """Keys of few lines go by one shuffle, those of many by ranges; both as plain code."""
    rnd = random.Random(9)
    lines = [(k, p, at, "é" * rnd.randrange(30)) for k in range(8) for p in range(5) for at in rnd.sample(range(10**7), rnd.randrange(1, 9 if k < 5 else 40))]
    df = spark.createDataFrame(lines, "key long, part int, at long, line string").repartition(4)
    for large in (0, 60, 10**6):
        got = {r.key: (r.text, r.n_parts) for r in budgets.bundles(df, "key", "part", "at", "line", 200, 20, large).collect()}
        assert got == plain(lines, 200, 20)
    sized = df.selectExpr("key", "part", "at", "line as _line", "cast(length(line) as long) + 1 as _size")
    plan = budgets.within(sized, "key", "part", "at", 200, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
