"""SimHash near-duplicate groups by the generalised pigeonhole principle.

1. A kernel makes a 64-bit fingerprint of each whole text. Only (id, fingerprint) goes on; it is written to the shared
   folder. Equal fingerprints are one node from here on, so a group of copies is one row however large.
2. Two counts over all nodes (how often a bit is set, and two bits together) group correlated bits into partitions that
   tell nodes apart equally well: a group of lopsided bits gets more of them. For each number of partitions up to the
   radius plus one a dynamic programme gives each partition a threshold (-1: not probed) so that thresholds plus one add
   up to the radius plus one, at the least estimated cost in probes and candidate pairs; the cheapest plan of all is
   taken. Few nodes get three partitions probed exactly; of very many, two with unequal thresholds are cheaper. By the
   generalised pigeonhole principle any two nodes within the radius are within its threshold in some probed partition.
3. A key is a mask of fixed bits and their values. Keys with more than GROUP nodes are split again: of the bits that
   are free, grouped in the same way into radius + 1 parts, two nodes within the radius agree in one. That ends at keys
   whose free bits allow no more than GROUP nodes, so no key is dropped or capped, and no task holds more than GROUP
   nodes of a key.
4. Sorted keys stream through a kernel that verifies pairs by popcount and returns a spanning star, not pairs.
5. Stars are merged by alternating large-star and small-star rounds on tables in the shared folder.

Defined results: null and empty texts have fingerprint zero, which links like any other; repeated rows and ties each
give a row; the group id is the smallest id in the group that is not null (null if all are); an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

BITS = 64
SEED = 42
#: Keys shared by more nodes than this are split, never cut off.
GROUP = 1024
#: What it costs to probe a node by one more mask (a row that is shuffled), in candidate pairs (a comparison in a batch).
PROBE = 50.0


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the text's shingles of `width` words, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; unsigned."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; unsigned, and zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """id (the id column's values) and fp, the fingerprint as a signed long."""

    def kernel(texts: list[bytes]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

    return runtime.map_rows(df, [id_col], text_col, kernel, "fp long").toDF("id", "fp")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of nodes and a matrix of how often two bits are set together; each task sends 64 x 64 sums."""
    runtime.python_path(nodes.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += bits.T @ bits
            n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.reshape(-1).astype(np.int64).tolist(), n], pa.int64())], names=["k", "n"])

    got = {r.k: r.s for r in nodes.select("fp").mapInArrow(sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("s")).collect()}
    return got.get(BITS * BITS, 0), np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def partitions(n: int, together: np.ndarray, parts: int, bits: list[int] | None = None) -> list[list[int]]:
    """Bits (all, or those given) in groups that tell nodes apart about equally well.

    A group begins with the free bit that is most correlated with the others and takes the free bit most correlated with
    those it has, until it has its share of the information: a bit has -log2 of the chance that two nodes agree in it.
    """
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    tells = np.maximum(-np.log2(p * p + (1 - p) ** 2), 1e-6)
    free, out = list(range(BITS)) if bits is None else list(bits), []
    for k in range(parts):
        share = tells[free].sum() / (parts - k)
        own: list[int] = []
        while free and len(free) > parts - k - 1 and (k == parts - 1 or not own or tells[own].sum() + tells[free].min() / 2 <= share):
            weight = corr[np.ix_(free, own)].sum(1) if own else corr[np.ix_(free, free)].sum(1)
            own.append(free.pop(int(np.argmax(weight))))
        out.append(sorted(own))
    return out


def candidates(n: int, p: np.ndarray, bits: list[int], most: int, probe: float = PROBE) -> list[float]:
    """Estimated cost of finding the pairs within distance t in these bits for t = -1 (none probed) to most.

    Pairs are those expected if each bit is taken by itself; each node is probed by a mask for every choice of t bits.
    """
    differ = np.array([1.0])
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        differ = np.convolve(differ, [1 - q, q])
    pairs = np.cumsum(differ)[: most + 1] * n * n / 2
    return [0.0, *(float(x) + probe * n * comb(len(bits), t) for t, x in enumerate(pairs))]


def thresholds(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds of least total cost whose sum of (threshold + 1) is radius + 1; costs[i][t + 1] is of threshold t."""
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(float("inf"), ())] * (radius + 1)
    for cost in costs:
        best = [min((best[total - used][0] + cost[used], (*best[total - used][1], used - 1)) for used in range(min(total, len(cost) - 1) + 1)) for total in range(radius + 2)]
    return list(best[radius + 1][1])


def plan(n: int, together: np.ndarray, radius: int, probe: float = PROBE) -> tuple[list[list[int]], list[int]]:
    """The partitions and their thresholds that cost least, over all numbers of partitions up to radius + 1."""
    p, best = np.diag(together) / max(n, 1), (float("inf"), [], [])
    for parts in range(1, radius + 2):
        cut = partitions(n, together, parts)
        costs = [candidates(n, p, bits, min(radius, len(bits)), probe) for bits in cut]
        limits = thresholds(costs, radius)
        if limits and (cost := sum(c[t + 1] for c, t in zip(costs, limits))) < best[0]:
            best = cost, cut, limits
    return best[1], best[2]


def _mask(bits) -> int:
    """The bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def probe_masks(parts: list[list[int]], limits: list[int]) -> list[int]:
    """Masks of fixed bits: for a partition with threshold t, all but each choice of t of its bits."""
    return [_mask(set(bits) - set(out)) for bits, t in zip(parts, limits, strict=True) if t >= 0 for out in combinations(bits, t)]


def _finer(fixed: int, radius: int, n: int, together: np.ndarray) -> list[int]:
    """The masks that split a key: its fixed bits and one of radius + 1 groups of the others."""
    held = [b for b in range(BITS) if fixed >> b & 1]
    free = [b for b in range(BITS) if not fixed >> b & 1]
    return [_mask(held + part) for part in partitions(n, together, radius + 1, free)]


def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (a, b), as pairs of nodes, as links of each node to the least one that it reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _stars(radius: int):
    """Kernel: rows sorted by (fixed, value) with fp; out come links to the smallest fp that a node reaches in a batch."""

    def links(fixed: np.ndarray, value: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(fp), bool)
        new[1:] = (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new) - 1
        left, right = [], []
        at, d = np.arange(len(fp)), 1
        while True:
            at = at[at + d < len(fp)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= radius]
            left.append(fp[near])
            right.append(fp[near + d])
            d += 1
        return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate((k, batch.column(i).to_numpy(zero_copy_only=False))) for i, k in enumerate(kept)]
            if not len(rows[0]):
                continue
            end = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + 1) if ((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).any() else 0
            kept = [x[end:] for x in rows]
            if end:
                yield star(*links(*(x[:end] for x in rows)))
        yield star(*links(*kept))

    return run


def links(nodes: DataFrame, radius: int = 2, group: int = GROUP, probe: float = PROBE) -> DataFrame:
    """Links (a > b) that span, with transitivity, all pairs of nodes (distinct fp) within the radius."""
    spark = nodes.sparkSession
    runtime.python_path(spark)
    n, together = bit_counts(nodes)
    masks = probe_masks(*plan(n, together, radius, probe))
    keys = nodes.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("fixed")).select("fixed", F.col("fixed").bitwiseAND(F.col("fp")).alias("value"), "fp")
    settled = None
    while True:
        crowded = keys.groupBy("fixed", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("fixed", "value")
        crowded = runtime.written(crowded, "simhash-crowded")
        fixed = [r.fixed for r in crowded.select("fixed").distinct().collect()]  # masks, not keys: at most (radius + 1) ** depth x the probes
        if not fixed:
            break
        quiet = keys.join(crowded, ["fixed", "value"], "left_anti")
        settled = quiet if settled is None else settled.unionByName(quiet)
        table = spark.createDataFrame([(m, f) for m in fixed for f in _finer(m & (1 << 64) - 1, radius, n, together)], "fixed long, next long")
        keys = keys.join(crowded, ["fixed", "value"]).join(F.broadcast(table), "fixed").select(F.col("next").alias("fixed"), F.col("next").bitwiseAND(F.col("fp")).alias("value"), "fp").distinct()
        keys = runtime.written(keys, "simhash-keys")
    settled = keys if settled is None else settled.unionByName(keys)
    dealt = settled.repartition("fixed", "value").sortWithinPartitions("fixed", "value")
    return dealt.mapInArrow(_stars(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Per node that has a smaller one in its component: a, and b the component's smallest node. edges: a > b."""

    def rounds(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(20,0)"))).first())

    edges = runtime.written(edges.distinct(), "simhash-edges")
    now = state(edges)
    while now[0]:
        edges = runtime.written(rounds(edges), "simhash-edges")
        before, now = now, state(edges)
        if now == before:
            break
    return edges


def _groups(df: DataFrame, id_col: str, text_col: str, width: int, radius: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), written; and nodes (fp, least id, root: the group's smallest fp)."""
    rows = runtime.written(fingerprints(df, id_col, text_col, width), "simhash-rows")
    nodes = runtime.written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    root = components(links(nodes, radius, group)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return rows, nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, group: int = GROUP) -> DataFrame:
    """Per row: the id column, fingerprint (16 hexadecimal digits), component_id (the group's smallest id)."""
    rows, nodes = _groups(df, id_col, text_col, width, radius, group)
    group_id = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(group_id, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").toDF(id_col, "fingerprint", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, group: int = GROUP) -> DataFrame:
    """df with one row of each group: the one with the smallest id (null last), then fingerprint, then row."""
    rows, nodes = _groups(df, id_col, text_col, width, radius, group)
    return first_rows(df, id_col, text_col, rows, nodes, lambda texts: {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)})


def first_rows(df: DataFrame, id_col: str, text_col: str, rows: DataFrame, nodes: DataFrame, kernel: Callable[[list[bytes]], dict[str, list]]) -> DataFrame:
    """df with one row of each group, given rows (id, fp), nodes (fp, least, root) and the kernel that makes fp.

    Only ids meet in the joins while ids are unique; rows whose id is null or repeated are told apart by fp, and then by
    their JSON, so any type of column will do. df's columns go by numbered names until the end.
    """
    first = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("id"), F.col("fp"))).alias("first")
    best = runtime.written(nodes.groupBy("root").agg(first).select(F.col("first.id").alias("id"), F.col("first.fp").alias("fp")), "simhash-first")
    ids = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    gone = ids.join(best.select("id").withColumn("stays", F.lit(True)), "id", "left").filter("n > 1 or stays is null").select("id", "n").distinct()
    gone = runtime.written(gone, "simhash-gone")
    whole = runtime.numbered(df)
    key, text = f"in_{df.columns.index(id_col)}", f"in_{df.columns.index(text_col)}"
    alone = whole.filter(F.col(key).isNotNull()).join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*whole.columns)
    several = gone.filter("n > 1").select(F.col("id").alias(key))
    unclear = whole.filter(F.col(key).isNull()).unionByName(whole.join(several, key, "left_semi").select(*whole.columns))
    row = unclear.select(F.struct(*whole.columns).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    marked = runtime.map_rows(row, ["row", "id"], "text", kernel, "fp long")
    picked = marked.join(best.select(F.col("id").alias("id_"), F.col("fp").alias("fp_")), F.col("id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_"))).groupBy("id", "fp").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.unionByName(picked.select(*(F.col(f"row.{c}") for c in whole.columns))).toDF(*df.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of documents."""
    return near_duplicates(runtime.table(spark, sf_dir, "documents", "doc_id", "text"))
