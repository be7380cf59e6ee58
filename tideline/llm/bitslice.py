"""Exact top-k inner products by a bit-sliced index.

Index: rows are packed into blocks of at most BLOCK vectors of one length. Of every component (whole numbers, floor of
scale * x) a block keeps the smallest value, and of what is above that the top WIDTH bits as slices: bitmaps over the
block's rows, one for each bit. Beside them stand the whole numbers, for rows at the boundary.

Search, for one query and one block:
1. The query's components are cut to WEIGHT_BITS bits too. A slice counts as often as its place and the weight's bits say;
   of a negative weight the complement is counted. All slices of one place are added by carry-save adders on whole
   bitmaps, three bitmaps to a sum and a carry, up to the slices of the rows' coarse scores.
2. From the most significant slice of the score downward the set of rows shrinks while it holds k; the bits met on the way
   are the k-th largest coarse score.
3. What the cuts left out is bounded (by the smaller of a sum of magnitudes and a product of norms). Rows whose coarse score
   is within that bound of the k-th, or of the best k found in blocks before, are selected by comparing slices with a
   number; they are resolved with the whole numbers. So results are exact, and the slices decide only how many are resolved.

Queries go in chunks of about CHUNK distinct ones: a chunk is broadcast, every task runs it over its blocks and gives the
best k + 1 of each query, which meet by query. Equal queries (same id, same vector) are searched once and counted.

Defined results: a vector that is null or has a null or non-finite component, or one whose number has no place in 62 bits,
takes no part; only vectors of one length are compared (empty ones score 0). A query leaves out its own row, once; other
rows with its id are candidates. Repeated rows are candidates, and queries, as often as they occur. A null id is no query
and comes after all ids in ties. Scores beyond a long are held at its ends. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .centroids import quantised

SCALE = 1024
TOP = 10
EVERY = 100
#: Rows of a block, bits kept of each component and of each weight, distinct queries of a chunk.
BLOCK = 16384
WIDTH = 6
WEIGHT_BITS = 5
CHUNK = 4096
LONGEST = (1 << 63) - 1

INDEX = "components int, n int, ids array<long>, size int, whole binary, low array<long>, shift array<int>, bits array<int>, slices binary, norm double, rest double"
_INDEX = pa.schema([("components", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("size", pa.int32()), ("whole", pa.binary()), ("low", pa.list_(pa.int64())), ("shift", pa.list_(pa.int32())), ("bits", pa.list_(pa.int32())), ("slices", pa.binary()), ("norm", pa.float64()), ("rest", pa.float64())])


def packed(flags: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words; missing ones are 0."""
    words = -(-flags.shape[-1] // 64)
    out = np.zeros((*flags.shape[:-1], words * 8), np.uint8)
    made = np.packbits(flags, axis=-1, bitorder="little")
    out[..., : made.shape[-1]] = made
    return out.view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the rows whose bits are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little", count=n))


class Block:
    """Rows of one length with the slices of their components."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, q: np.ndarray, low: list[int], shift: list[int], bits: list[int], slices: np.ndarray, norm: float, rest: float):
        self.ids, self.known, self.q, self.low, self.shift, self.bits, self.norm, self.rest = ids, known, q, low, shift, bits, norm, rest
        self.n, self.words = len(q), -(-len(q) // 64)
        self.slices = slices.reshape(-1, self.words)
        self.first = np.concatenate(([0], np.cumsum(bits)))[:-1].tolist() if bits else []
        self.all = packed(np.ones(self.n, bool))
        self.largest = max((abs(int(q.min())), abs(int(q.max())))) if q.size else 0
        self.exact = q.astype(np.float64) if self.largest < 1 << 22 else None

    @staticmethod
    def parts(q: np.ndarray, width: int = WIDTH) -> tuple[list[int], list[int], list[int], np.ndarray, float, float]:
        """Lowest values, shifts and bits by component, slices, and the largest norms of rows and of what the shifts cut off.

        What is cut off a component of shift s is counted from the middle of 0 and 2 ** s - 1.
        """
        n, width_of, shifts, lows, made = len(q), [], [], [], []
        gone = np.zeros(n)
        for j in range(q.shape[1]):
            column = q[:, j]
            low, high = int(column.min()), int(column.max())
            above = column.astype(np.uint64) - np.uint64(low % (1 << 64))  # modulo 2 ** 64: the difference of two longs has room
            shift = max(0, (high - low).bit_length() - width)
            coarse = above >> np.uint64(shift)
            count = ((high - low) >> shift).bit_length()
            made += [packed((coarse >> np.uint64(b) & np.uint64(1)).astype(bool)) for b in range(count)]
            gone += ((above & np.uint64((1 << shift) - 1)).astype(np.float64) - ((1 << shift) - 1) / 2) ** 2
            lows.append(low), shifts.append(shift), width_of.append(count)
        slices = np.stack(made) if made else np.zeros((0, -(-n // 64)), np.uint64)
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        return lows, shifts, width_of, slices, float(norms.max(initial=0)), float(np.sqrt(gone).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, known: np.ndarray, q: np.ndarray, width: int = WIDTH) -> Block:
        return cls(ids, known, q, *cls.parts(q, width))

    def coarse(self, query: list[int], weight_bits: int = WEIGHT_BITS) -> tuple[int, list[np.ndarray], float, float]:
        """(place of the lowest slice, slices of the coarse scores, what to add to them, how far they may be off)."""
        cut = max(0, max((abs(x) for x in query), default=0).bit_length() - weight_bits)
        half = 1 << cut >> 1
        weights = [(x + half) >> cut << cut for x in query]
        at: dict[int, list[int]] = {}
        total = len(self.slices)
        base, loss, square = 0, 0.0, 0.0
        for w, low, shift, bits, first in zip(weights, self.low, self.shift, self.bits, self.first):
            size, over = abs(w), (1 << shift) - 1
            base += 2 * w * low + w * over  # twice, for the middle of what is cut off may be a half
            if w < 0:
                base -= 2 * size * (((1 << bits) - 1) << shift)
            loss += size * over / 2
            square += float(size) ** 2
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b in range(bits):
                        at.setdefault(shift + b + j, []).append(first + b + (total if w < 0 else 0))
        rest = [x - w for x, w in zip(query, weights)]
        off = min(loss, square**0.5 * self.rest) + sum(float(x) ** 2 for x in rest) ** 0.5 * self.norm
        lowest = min(at, default=0)
        return lowest, self._sum(at, lowest), base / 2, off * (1 + 1e-9) + abs(base) * 1e-15 + 1

    def _sum(self, at: dict[int, list[int]], lowest: int) -> list[np.ndarray]:
        """The bitmaps of each place added up: one bitmap for each place of the sum."""
        both, out, place, carried = self._both(), [], lowest, []
        last = max(at, default=-1)
        while place <= last or carried:
            stack = np.concatenate([both[at[place]], *carried]) if at.get(place) else (np.concatenate(carried) if carried else np.zeros((1, self.words), np.uint64))
            carried = []
            while len(stack) > 1:
                n = len(stack) // 3
                if n:
                    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                    ab = a ^ b
                    carried.append(a & b | ab & c)
                    stack = np.concatenate([ab ^ c, stack[3 * n :]]) if 3 * n < len(stack) else ab ^ c
                else:
                    carried.append((stack[0] & stack[1])[None])
                    stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0])
            place += 1
            carried = [c for c in carried if c.any()] if place > last else carried
        return out

    def _both(self) -> np.ndarray:
        """Slices, then their complements."""
        if not hasattr(self, "_pair"):
            self._pair = np.concatenate([self.slices, ~self.slices & self.all])
        return self._pair

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest coarse score in units of the lowest place; 0 if there are fewer rows."""
        sure, tied, value = 0, self.all, 0
        if self.n < k:
            return 0
        for place in range(len(sums) - 1, -1, -1):
            some = tied & sums[place]
            n = int(np.bitwise_count(some).sum())
            if sure + n >= k:
                tied, value = some, value | 1 << place
            else:
                sure, tied = sure + n, tied & ~sums[place]
        return value

    def at_least(self, sums: list[np.ndarray], least: int) -> np.ndarray:
        """The rows whose coarse score is a number or more."""
        if least <= 0:
            return self.all
        if least >= 1 << len(sums):
            return np.zeros_like(self.all)
        above, tied = np.zeros_like(self.all), self.all
        for place in range(len(sums) - 1, -1, -1):
            if least >> place & 1:
                tied = tied & sums[place]
            else:
                above, tied = above | tied & sums[place], tied & ~sums[place]
        return above | tied

    def search(self, query: list[int], k: int, known: int | None = None) -> list[tuple[int, bool, int]]:
        """The best k rows as (score, id is null, id), best first; rows below a known k-th score may be left out."""
        if not self.n:
            return []
        lowest, sums, base, off = self.coarse(query)
        least = self.kth(sums, k) - 2 * off / 2.0**lowest
        if known is not None:
            least = max(least, (known - base - off) / 2.0**lowest)
        rows = unpacked(self.at_least(sums, int(np.ceil(least))) & self.all, self.n)
        if not len(rows):
            return []
        if self.exact is not None and max((abs(x) for x in query), default=0) < 1 << 22 and len(query) <= 256:
            score = (self.exact[rows] @ np.array(query, np.float64)).astype(np.int64)
        else:
            score = np.array([min(max(int(x), -LONGEST - 1), LONGEST) for x in (self.q[rows].astype(object) * np.array(query, object)).sum(1)] if len(query) else [0] * len(rows), np.int64)
        if len(rows) > 4 * k:  # the k-th best and what ties with it
            bar = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= bar], score[score >= bar]
        order = np.lexsort((self.ids[rows], ~self.known[rows], ~score))[:k]
        return [(int(score[i]), not bool(self.known[rows[i]]), int(self.ids[rows[i]])) for i in order]


def vectors(df: DataFrame, id_col: str, embedding_col: str, scale: int) -> DataFrame:
    """(vec_id, q) of the rows that take part."""
    return df.select(runtime.column(id_col).cast("long").alias("vec_id"), quantised(runtime.column(embedding_col), scale).alias("q")).filter("q is not null")


def index(rows: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Blocks of (vec_id, q); a task packs the rows it reads, so nothing is shuffled and memory is that of a block."""
    runtime.python_path(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def made(size: int) -> pa.RecordBatch:
            parts = held.pop(size)
            ids, q = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            del count[size]
            low, shift, bits, slices, norm, rest = Block.parts(q, width)
            most = max(abs(int(q.min())), abs(int(q.max()))) if q.size else 0
            kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
            values = [size, len(q), ids.to_pylist(), np.dtype(kind).itemsize, q.astype(kind).tobytes(), low, shift, bits, slices.tobytes(), norm, rest]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX)], schema=_INDEX)

        for batch in batches:
            flat, sizes = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                q = flat[starts[at][:, None] + np.arange(size)].astype(np.int64).reshape(len(at), size)
                for a in range(0, len(at), block):  # a batch has few rows
                    held.setdefault(size, []).append((batch.column(0).take(pa.array(at[a : a + block])), q[a : a + block]))
                    count[size] = count.get(size, 0) + len(at[a : a + block])
                    if count[size] >= block:
                        yield made(size)
            while sum(count.values()) > 4 * block:  # many lengths: the fullest goes
                yield made(max(count, key=count.get))
        for size in list(held):
            yield made(size)

    return rows.select("vec_id", "q").mapInArrow(run, INDEX)


def _block(row: dict) -> Block:
    n, size = row["n"], row["components"]
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["size"]]
    known = np.array([x is not None for x in row["ids"]], bool)
    ids = np.array([LONGEST if x is None else x for x in row["ids"]], np.int64)
    return Block(ids, known, np.frombuffer(row["whole"], kind).reshape(n, size), row["low"], row["shift"], row["bits"], np.frombuffer(row["slices"], np.uint64), row["norm"], row["rest"])


def _best(blocks: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(place among the sent queries, vec_id, score): each task's best k of each query, over all of its blocks."""
    schema = pa.schema([("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch.slice(i, 1).to_pylist()[0])
                for number, query in enumerate(sent.value):
                    if len(query) != block.q.shape[1]:
                        continue
                    so_far = best.get(number, [])
                    found = block.search(query, k, so_far[-1][0] if len(so_far) == k else None)
                    if found:
                        best[number] = sorted(so_far + found, key=lambda x: (-x[0], x[1], x[2]))[:k]
        rows = [(number, None if null else i, score) for number, found in best.items() for score, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return blocks.mapInArrow(run, "place int, vec_id long, score long")


def search(blocks: DataFrame, queries: DataFrame, k: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, q) that are rows of the index themselves; equal ones are searched once.

    A chunk's queries are what the driver and each task hold; they are told apart by hash, so that a chunk's size does not
    depend on ids. Each chunk is one pass over the index and ends in a table in the shared folder.
    """
    spark = queries.sparkSession
    asked = runtime.written(queries.groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("copies")), "bitslice-queries")
    chunks = max(1, -(-asked.count() // chunk))
    part = F.pmod(F.xxhash64("vec_id", "q"), F.lit(chunks))
    schema, path = "number long, query_id long, copies long, own long, vec_id long, score long", runtime.new_path(spark, "bitslice-best")
    for c in range(chunks):
        rows = asked.filter(part == c).collect()  # about `chunk` rows
        facts = spark.createDataFrame([(i, (c << 32) + i, r.vec_id, r.copies, min(sum(x * x for x in r.q), LONGEST)) for i, r in enumerate(rows)], f"place int, {schema.split(', vec_id')[0]}")
        first = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        sent = spark.sparkContext.broadcast([list(r.q) for r in rows])
        best = _best(blocks, sent, k + 1).withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k + 1)
        best.join(F.broadcast(facts), "place").select("number", "query_id", "copies", "own", "vec_id", "score").write.mode("append").parquet(path)
        sent.unpersist()  # the next chunk takes its place
    return ranked(spark.read.schema(schema).parquet(path), k)


def ranked(found: DataFrame, k: int = TOP) -> DataFrame:
    """The best k of each query without its own row, for each of its copies."""
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    which = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    first = F.min(F.when(own, F.col("_place"))).over(Window.partitionBy("number"))
    placed = found.withColumn("_place", which).withColumn("_own", first)
    rank = F.col("_place") - F.when(F.col("_place") > F.col("_own"), 1).otherwise(0)
    kept = placed.filter(~F.coalesce(F.col("_place") == F.col("_own"), F.lit(False))).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    return kept.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")


def op13_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector of embeddings with all others."""
    rows = vectors(runtime.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", SCALE)
    blocks = runtime.written(index(rows), "bitslice-index")
    return search(blocks, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), s as (
  select a.r, a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % {EVERY} = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as integer) as rank, vec_id, score from s
qualify rank <= {TOP}
"""
