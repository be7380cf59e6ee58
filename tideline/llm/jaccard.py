"""Near-duplicate groups by SimHash, completed by minima in bands: every link has a Jaccard similarity of 0.8 or more of five-word shingles, verified exactly.

1. A kernel makes of each whole text the set of its shingles' hashes, a digest of that set (texts with one digest are one
   node from here on), the set's SimHash fingerprint, BANDS keys of ROWS minima each, and a sketch: four bits of each of
   the BANDS x ROWS minima. A pair whose sizes rule 0.8 out, or whose sketches differ in more than APART places, is not
   looked at further: at 0.8 that many differ with a chance under 1 in 100,000.
2. Fingerprints within RADIUS bits are linked by simhash.links, without loss, and their components are keys of the nodes.
   Sets of similarity 0.8 may differ in more bits than that; so each band is a key as well, and two sets of similarity s
   share one with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8.
3. Every node of a key is compared with one of them, the pivot, which is the same for most keys of a group of copies. The
   links found make components, and a key of two nodes, or with all nodes in one component, is done. While a key is too
   large for step 4 this is done anew, with other pivots, a few times.
4. The sets of a key that still has several components are compared in one task, all with all by counting what they have
   in common in matrix products, and what comes out is a spanning star of the links. That is done for keys of at most
   GROUP nodes and ELEMENTS hashes. The nodes of larger ones get new, finer keys, for which steps 3 and 4 are done again:
   of so many rows as make keys of texts at a similarity of 0.7 small enough, and so many keys that a pair at 0.8 shares
   one with probability 0.9999 again. No key is dropped, capped or sampled.
5. All links are verified on the whole sets, in integers; only texts that are in an open key are shingled again for that.
6. Links are merged by simhash.components.

Defined results: null and empty texts are one node; a text of fewer words than a shingle is one shingle; the group's row
is chosen as in simhash.first_rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, simhash

WIDTH = 5
#: Bits in which linked fingerprints may differ.
RADIUS = 2
BANDS, ROWS = 24, 5
GROUP = 2048
ELEMENTS = 4 << 20
#: Rounds of pivots in keys that are too large.
PIVOTS = 3
#: Places of 120 in which the sketches of a pair may differ.
APART = 42
#: Rows of a finer key, at most. Sets that agree in so many minima are compared in one task, however many they are.
MOST_ROWS = 40


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, WIDTH))


def digest(own: np.ndarray) -> int:
    """A set's node, unsigned; zero for an empty one."""
    return xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED) if len(own) else 0


@lru_cache(4)
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    odd, add = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (2, n, 1), np.uint64)
    return odd | np.uint64(1), add


def minima(own: np.ndarray, n: int = BANDS * ROWS, seed: int = 42) -> np.ndarray:
    """The least value of each of n hash functions over a set that is not empty."""
    odd, add = _functions(n, seed)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 18) // n)
    for at in range(0, len(own), step):
        least = np.minimum(least, (own[at : at + step] * odd + add).min(1))
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The set's keys, of so many minima each."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(-1, rows))], np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a number."""
    nibbles = np.zeros(128, np.uint64)
    nibbles[: len(least)] = least >> np.uint64(24) & np.uint64(15)
    return np.bitwise_or.reduce(nibbles.reshape(8, 16) << np.arange(0, 64, 4, dtype=np.uint64), 1).view(np.int64)


def marks(texts: list[bytes]) -> dict[str, list]:
    """Kernel: fp, the node."""
    return {"fp": np.array([digest(shingles(t)) for t in texts], np.uint64).view(np.int64)}


def _signed(texts: list[bytes]) -> dict[str, list]:
    sets = [shingles(t) for t in texts]
    least = [minima(s) if len(s) else None for s in sets]
    prints = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
    return {"fp": np.array([digest(s) for s in sets], np.uint64).view(np.int64), "n": list(map(len, sets)), "print": prints, "sketch": [[] if x is None else sketch(x).tolist() for x in least], "bands": [[] if x is None else bands(x).tolist() for x in least]}


def _sets(texts: list[bytes]) -> dict[str, list]:
    sets = [shingles(t) for t in texts]
    return {"fp": np.array([digest(s) for s in sets], np.uint64).view(np.int64), "own": [s.view(np.int64).tolist() for s in sets]}


def _finer(rows: int, count: int):
    """Kernel: fp, n and keys, as many as count, of so many rows."""

    def kernel(texts: list[bytes]) -> dict[str, list]:
        sets = [shingles(t) for t in texts]
        keys = [bands(minima(s, rows * count, rows), rows).tolist() if len(s) else [] for s in sets]
        return {"fp": np.array([digest(s) for s in sets], np.uint64).view(np.int64), "n": list(map(len, sets)), "bands": keys}

    return kernel


def _made_of(wanted: DataFrame, kernel, made: str, df: DataFrame, rows: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp and what a kernel makes of the text, for the wanted nodes; written.

    A node whose least id is unique is that row's; the others are looked for by fp among rows whose id is null or repeated.
    """
    of = runtime.written(nodes.join(wanted, "fp", "left_semi").select("fp", "least"), "jaccard-wanted")
    several = runtime.written(rows.filter("id is not null").groupBy(F.col("id").alias("least")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least"), "jaccard-several")
    texts = df.select(runtime.column(id_col), runtime.column(text_col)).toDF("id", "text")
    ids = lambda found: found.select(F.col("least").alias("id")).distinct()
    of_text = lambda some: runtime.map_rows(some, [], "text", kernel, f"fp long, {made}")
    alone = of_text(texts.join(ids(of.filter("least is not null").join(several, "least", "left_anti")), "id", "left_semi"))
    unclear = of.join(several, "least", "left_semi").select("least", "fp")
    among = of_text(texts.join(ids(unclear), "id", "left_semi").unionByName(texts.filter("id is null")))
    others = unclear.select("fp").unionByName(of.filter("least is null").select("fp"))
    return runtime.written(alone.unionByName(among.join(others, "fp", "left_semi").dropDuplicates(["fp"])), "jaccard-sets")


def keys_of_bands(nodes: DataFrame) -> DataFrame:
    """(fp, n, key) for each band of each node."""
    return nodes.select("fp", "n", F.posexplode("bands").alias("band", "value")).select("fp", "n", F.xxhash64("band", "value").alias("key"))


def keys_of_prints(nodes: DataFrame) -> DataFrame:
    """(fp, n, key): nodes whose fingerprints are linked, directly or not, have one key."""
    prints = nodes.filter("n > 0").select(F.col("print").alias("fp")).distinct()
    root = simhash.components(simhash.links(prints, RADIUS)).select(F.col("a").alias("print"), F.col("b").alias("root"))
    return nodes.filter("n > 0").select("fp", "n", "print").join(root, "print", "left").select("fp", "n", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"))


def _plausible(x: str, y: str) -> str:
    """SQL: sizes and sketches of two nodes allow a similarity of 0.8."""
    bits = lambda i: f"({x}.sketch[{i}] ^ {y}.sketch[{i}])"
    apart = " + ".join(f"bit_count(({b} | shiftrightunsigned({b}, 1) | shiftrightunsigned({b}, 2) | shiftrightunsigned({b}, 3)) & 1229782938247303441L)" for b in map(bits, range(8)))
    return f"5 * {x}.n >= 4 * {y}.n and 5 * {y}.n >= 4 * {x}.n and {apart} <= {APART}"


def _verified(pairs: DataFrame, sets_of) -> DataFrame:
    """The pairs (a > b) whose whole sets have a similarity of 0.8 or more; written."""
    sets = sets_of(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct())
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("own").alias(f"of_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # common / (total - common) >= 4 / 5
    return runtime.written(both.filter("9L * size(array_intersect(of_a, of_b)) >= 4L * (size(of_a) + size(of_b))").select("a", "b"), "jaccard-links")


def _merged(found: list[DataFrame]) -> DataFrame:
    """fp and root of the nodes that have a smaller one in their component."""
    return simhash.components(reduce(DataFrame.unionByName, found)).select(F.col("a").alias("fp"), F.col("b").alias("root"))


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of sets with a similarity of 0.8 or more, from products of blocks of the incidence matrix."""
    n = np.array(list(map(len, sets)))
    of = np.repeat(np.arange(len(sets)), n)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    of, code = of[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers: exact below 2 ** 24
    width = 1 << 11
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (at, at + width))
        block = np.zeros((len(sets), width), np.float32)
        block[of[a:b], code[a:b] - at] = 1
        common += block @ block.T
    i, j = np.nonzero(9 * common.astype(np.int64) >= 4 * (n[:, None] + n))
    return i[i < j], j[i < j]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: rows (key, fp, own) sorted by key; links of each key to the least node of its components in it."""
    key, fps, sets = None, [], []

    def done() -> pa.RecordBatch:
        fp = np.array(fps, np.int64)
        i, j = similar(sets) if len(sets) > 1 else (np.zeros(0, int),) * 2
        return simhash.star(fp[i], fp[j])

    for batch in batches:
        for k, f, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if k != key and fps:
                yield done()
                fps, sets = [], []
            key = k
            fps.append(f)
            sets.append(own.values.to_numpy().copy())
    if fps:
        yield done()


def groups(df: DataFrame, rows: DataFrame, nodes: DataFrame, id_col: str, text_col: str, group: int = GROUP, elements: int = ELEMENTS) -> DataFrame:
    """fp and root of the nodes that have a smaller one in their component, by the links of nodes (fp, n, print, sketch, bands, least) that share a key."""
    info = nodes.select("fp", "n", "sketch")
    of_nodes = lambda wanted, kernel, made: _made_of(wanted, kernel, made, df, rows, nodes, id_col, text_col)
    sets_of = lambda wanted: of_nodes(wanted, _sets, "own array<long>")
    keys, root, width = keys_of_prints(nodes).unionByName(keys_of_bands(nodes)), None, ROWS
    found: list[DataFrame] = []
    of_root = lambda k: k.withColumn("root", F.col("fp")) if root is None else k.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    while True:
        small = F.expr(f"size <= {group} and weight <= {elements}") if width < MOST_ROWS else F.lit(True)
        for k in range(PIVOTS):
            pivots = of_root(keys).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias("z"), (F.min("root") < F.max("root")).alias("open"))
            pivots = runtime.written(pivots.filter(F.expr(f"size > {1 if k == 0 else 2} and open")), "jaccard-pivots")
            if k and pivots.filter(~small).isEmpty():
                break
            keys = runtime.written(keys.select("key", "fp", "n").join(pivots, "key"), "jaccard-keys")
            star = (keys if k == 0 else keys.filter(~small)).filter("fp <> z").select(F.greatest("fp", "z").alias("a"), F.least("fp", "z").alias("b")).distinct()
            of = lambda x: info.select(F.col("fp").alias(x), F.struct("n", "sketch").alias(f"of_{x}"))
            star = star.join(of("a"), "a").join(of("b"), "b").filter(_plausible("of_a", "of_b")).select("a", "b")
            found.append(_verified(runtime.written(star, "jaccard-pairs"), sets_of))
            root = _merged(found)
        few = keys.select("key", "fp").join(pivots.filter(small).select("key"), "key")
        dealt = few.join(sets_of(few.select("fp").distinct()), "fp").select("key", "fp", "own").repartition("key").sortWithinPartitions("key")
        found.append(runtime.written(dealt.mapInArrow(_compared, "a long, b long").distinct(), "jaccard-links"))
        root = _merged(found)
        large = pivots.filter(~small)
        most = large.agg(F.max(F.greatest(F.col("size") / group, F.col("weight") / elements)).alias("x")).first().x
        if most is None:
            return root
        width = min(MOST_ROWS, width + max(5, int(np.ceil(np.log(most) / np.log(1 / 0.7)))))
        count = int(np.ceil(np.log(1e-4) / np.log(1 - 0.8**width)))
        again = keys.select("key", "fp").join(large.select("key"), "key", "left_semi").select("fp").distinct()
        keys = keys_of_bands(of_nodes(again, _finer(width, count), "n long, bands array<long>"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, elements: int = ELEMENTS) -> DataFrame:
    """df with one row of each group: the one with the smallest id (null last), then node, then row."""
    rows = runtime.written(runtime.map_rows(df, [id_col], text_col, _signed, "fp long, n long, print long, sketch array<long>, bands array<long>").toDF("id", "fp", "n", "print", "sketch", "bands"), "jaccard-rows")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = runtime.written(nodes, "jaccard-nodes")
    root = groups(df, rows, nodes, id_col, text_col, group, elements)
    nodes = nodes.select("fp", "least").join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return simhash.first_rows(df, id_col, text_col, rows.select("id", "fp"), nodes, marks)
