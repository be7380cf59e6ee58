"""Relations to their end, exact order statistics and searches by index, against plain code."""

import math
import random
import re

import pytest

from tideline.operators import graphs, quantiles, trigrams


def ways(edges):
    out = {}
    nodes = {a for a, b in edges if a is not None and b is not None}
    for a in nodes:
        seen, front, steps = {}, {a}, 0
        while front:
            steps += 1
            front = {y for x, y in edges if x in front and y is not None} - seen.keys()
            seen |= dict.fromkeys(front, steps)
        out |= {(a, b): n for b, n in seen.items()}
    return out


def test_all_that_is_reachable_with_cycles_and_several_ways(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(33)] + [(7, 7), (None, 3), (3, None), (100, 101)]
    found, rounds = graphs.reachable(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.a, r.b): r.steps for r in found.collect()} == ways(edges)
    assert rounds <= math.ceil(math.log2(33)) + 2
    assert graphs.reachable(spark.createDataFrame([(None, 1)], "a long, b long"))[0].count() == 0


def test_chains_and_what_runs_into_a_cycle(spark):
    links = [(i, i + 1) for i in range(70)] + [(200, 201), (201, 202), (202, 200), (210, 211), (211, 212), (212, 200), (300, 300), (400, 70), (401, 70)]
    found, rounds = graphs.chains(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: (r.steps, r.cyclic) for r in found.collect()}
    want = {i: (70 - i, False) for i in range(71)} | dict.fromkeys((200, 201, 202, 210, 211, 212, 300), (None, True)) | {400: (1, False), 401: (1, False)}
    assert got == want and rounds <= 9
    assert graphs.chains(spark.createDataFrame([], "a long, b long"))[0].count() == 0


@pytest.mark.parametrize("ranges", [64, 4096])
def test_order_statistics_of_one_key_with_all_rows(spark, ranges):
    rnd = random.Random(4)
    values = [rnd.choice([0.0, 1.5, rnd.gauss(0, 1), rnd.gauss(0, 1e-9), rnd.choice([1, -1]) * 10.0 ** rnd.randrange(-30, 30)]) for _ in range(900)] + [5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("k", float("nan")), ("one", 3.0), (None, 1.0)], "key string, v double").repartition(6)
    wanted = [1, 2, 3, 450, 451, 900, len(values) - 1, len(values), len(values) + 1, 0]
    found = quantiles.nth(df, ["key"], "v", spark.createDataFrame([("k", r) for r in wanted] + [("one", 1)], "key string, rank long"), ranges)
    want = {("k", r): sorted(values)[r - 1] for r in wanted if 1 <= r <= len(values)} | {("one", 1): 3.0}
    assert {(r.key, r["rank"]): r.v for r in found.collect()} == want


def test_exclusive_quantiles(spark):
    import statistics

    rnd = random.Random(8)
    data = {"a": [rnd.choice([1.0, 2.0, rnd.random()]) for _ in range(301)], "b": [1.0, 4.0], "c": [float(i) for i in range(19)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "key string, v double")
    got = {r.key: r.v for r in quantiles.exclusive(df, ["key"], "v", 0.95).collect()}
    assert got == pytest.approx({k: statistics.quantiles(v, n=20)[18] for k, v in data.items()})


def test_no_task_sorts_a_key(spark):
    """The plan of a round counts by range: no window and no sort over rows, only over ranges."""
    df = spark.range(1000).selectExpr("'k' as key", "double(id) as v")
    plan = quantiles.nth(df, ["key"], "v", spark.createDataFrame([("k", 500)], "key string, rank long"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_an_index_of_trigrams_reads_few_blocks(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "İx Straße Æther", -4: "ab"}
    trigrams.build(docs.unionByName(spark.createDataFrame([(k, rows[k]) for k in (-1, -2, -3, -4)], "doc_id long, text string")), "doc_id", "text", path, 100)
    whole = trigrams.bytes_of(spark, path, [r.block for r in spark.read.parquet(f"{path}/rows").select("block").distinct().collect()])
    some = next(m[0] for t in rows.values() if (m := re.search("[0-9a-f]{40,}", t or "")))  # words are in every block, such a string is not
    needles = ["", "a", "AB", "i̇x", "traß", "ÆTHER", "no such words at all", *(some[:n] for n in (3, 6, 12, 40)), None]
    found = trigrams.search(spark, path, spark.createDataFrame([(n,) for n in needles], "needle string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.needle, set()).add(r.id)
    assert got == {n: s for n in needles if n is not None and (s := {k for k, t in rows.items() if t is not None and n.lower() in t.lower()})}
    size = {}
    for n in (3, 6, 12, 40):
        blocks = [r.block for r in trigrams.candidates(spark, path, spark.createDataFrame([(some[:n],)], "needle string")).collect()]
        size[n] = trigrams.bytes_of(spark, path, blocks)
    print("bytes read of", whole, size)
    assert size[12] < 0.2 * whole and size[40] <= size[12] <= size[6] <= size[3] <= whole


def test_each_way_is_written_once(spark):
    """The rounds' tables hold each way once, not all ways known so far."""
    from pathlib import Path

    from tideline.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("reachable-*"))
    edges = [(i, i + 1) for i in range(40)] + [(40, 30), (3, 9), (50, 50)]
    found, _ = graphs.reachable(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.a, r.b): r.steps for r in found.collect()} == ways(edges)
    (mine,) = set(folder.glob("reachable-*")) - before
    assert sum(spark.read.parquet(str(p)).count() for p in mine.iterdir()) == found.count()


def test_trigrams_are_numbers_in_the_index_and_in_needles(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    texts = ["Straße 𝒜bc", "ab", "", None, "xyz" * 2000, "İx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    trigrams.build(df, "id", "text", path, 1)
    small = [r.text for r in spark.read.parquet(f"{path}/rows").collect()]
    assert sorted(t for t in small if t is not None) == sorted(r.t for r in df.selectExpr("lower(text) as t").collect() if r.t is not None)
    want = {sum(ord(c) << 21 * (2 - k) for k, c in enumerate(t[i : i + 3])) for t in small if t for i in range(len(t) - 2)}
    kept = {r.gram for r in spark.read.parquet(f"{path}/grams").collect()}
    assert want <= kept and want == {g for r in df.select(trigrams.grams(df["text"]).alias("g")).collect() for g in r.g or []}
