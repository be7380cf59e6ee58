"""Centroid clustering by delta Lloyd: after the first round only what has changed is compared and added.

1. Vectors become whole numbers, floor(scale * x). The first k by a seeded hash of their ids are the centroids.
2. Assignments (vector, cluster, distance) are a Parquet table in the shared folder, written anew each round with the
   vectors that changed owner in a partition of their own; the global sums are k rows of n and a total by component.
3. A round reads the last table. A vector whose centroid moved is compared with all centroids; any other only with those
   that moved, since its distances to the rest, and their order, are what they were.
4. Of the partition that changed owner each task adds up signed transfers (minus at the old owner, plus at the new), so
   at most 2k rows a task cross the network, and the sums change by those. Nothing is shuffled by vector or by cluster, so
   equal vectors and a cluster that holds most rows do no harm. A table is deleted once the round after it is complete.
5. If no centroid moves, later rounds would change nothing and are left out.

Sums and distances are exact: float64 products while every number is below 2 ** 22, Python's whole numbers beyond.

Defined results: vectors of another length, or null, or holding null or non-finite components or ones whose number has no
place in 62 bits, are left out. Repeated rows each give a row. Ids with the same hash are ordered by their vectors; a null
id hashes as an empty text. With fewer than k vectors each is a centroid; with none there are no rows. A distance or sum
beyond a long is held at the largest long; comparisons are made before that. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

SCALE = 256
COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Largest number whose products and sums of 64 are exact in float64.
EXACT = 1 << 22
LONGEST = (1 << 63) - 1
STATE = "vec_id long, q array<long>, was int, cluster int, distance long, moved boolean"


def quantised(embedding: Column, scale: int, components: int | None = None) -> Column:
    """floor(scale * x) of every component, or null for what is no vector of finite numbers (of that many)."""
    number = lambda x: F.lit(float(scale)) * x.cast("double")
    sound = F.forall(embedding, lambda x: F.coalesce(F.abs(number(x)) < float(1 << 62), F.lit(False)))
    if components is not None:
        sound = (F.size(embedding) == components) & sound
    return F.when(sound, F.transform(embedding, lambda x: F.floor(number(x)).cast("long")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def squared(q: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centres: float64 where that is exact, else Python's whole numbers."""
    c = np.array(centres, object)
    if not q.size or max(int(np.abs(q).max()), max(abs(int(x)) for x in c.flat)) < EXACT:
        a, b = q.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    a = q.astype(object)
    return np.stack([((a - x) ** 2).sum(1) for x in c], 1)


def nearest(q: np.ndarray, own: np.ndarray, distance: np.ndarray, centres: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of each row after a round; own is -1 where there is none yet. Ties go to the smaller number."""
    own, distance = own.copy(), distance.copy()
    far = q.size and (int(np.abs(q).max()) >= EXACT or any(abs(x) >= EXACT for c in centres for x in c))
    whole = np.isin(own, changed) | (own < 0) | bool(far)  # distances beyond a long are not kept, so they are made again

    def best(rows: np.ndarray, among: list[int]) -> tuple[np.ndarray, np.ndarray]:
        d = squared(q[rows], [centres[k] for k in among])
        at = d.argmin(1)
        least = d[np.arange(len(at)), at]
        return np.array(among, np.int64)[at], (np.minimum(least, LONGEST) if least.dtype == object else least).astype(np.int64)

    if whole.any():
        own[whole], distance[whole] = best(whole, list(range(len(centres))))
    rest = np.flatnonzero(~whole)
    if len(rest) and changed:
        k, d = best(rest, changed)
        wins = (d < distance[rest]) | ((d == distance[rest]) & (k < own[rest]))
        own[rest[wins]], distance[rest[wins]] = k[wins], d[wins]
    return own, distance


def _assigned(rows: DataFrame, centres: list[list[int]], changed: list[int]) -> DataFrame:
    """The next table of assignments from (vec_id, q, cluster, distance)."""
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.int64())), ("was", pa.int32()), ("cluster", pa.int32()), ("distance", pa.int64()), ("moved", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, was, before = matrix(batch.column(1)), batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            own, distance = nearest(q, was, before, centres, changed) if len(q) else (was, before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema[1].type), pa.array(was.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(distance), pa.array(own != was)], schema=schema)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "q", F.col("cluster").cast("int").alias("cluster"), F.col("distance").cast("long").alias("distance")).mapInArrow(run, STATE)


def transfers(moved: DataFrame) -> DataFrame:
    """(cluster, component, total): what vectors that changed owner take from one and bring to another; component -1 counts them."""
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            q = matrix(batch.column(0))
            small = not q.size or int(np.abs(q).max()) < 1 << 40  # a batch's sums have room in int64
            for side, sign in ((batch.column(1).to_numpy(), -1), (batch.column(2).to_numpy(), 1)):
                for k in np.unique(side[side >= 0]).tolist():
                    rows = q[side == k]
                    sums = (rows if small else rows.astype(object)).sum(0)
                    for j, x in enumerate([len(rows), *sums.tolist()]):
                        totals[k, j - 1] = totals.get((k, j - 1), 0) + sign * int(x)
        found = sorted(totals)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([j for _, j in found], pa.int32()), pa.array([Decimal(totals[x]) for x in found], pa.decimal128(38, 0))], schema=schema)

    parts = moved.select("q", "was", "cluster").mapInArrow(run, "cluster int, component int, total decimal(38,0)")
    return parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids: k rows of fixed length come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.q) for r in vectors.select("q", key.alias("key")).orderBy("key", "q").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """The last table of assignments (vec_id, q, cluster, distance) and the last centroids."""
    spark = df.sparkSession
    runtime.python_path(spark)
    vectors = df.select(runtime.column(id_col).cast("long").alias("vec_id"), quantised(runtime.column(embedding_col), scale, components).alias("q")).filter("q is not null")
    centres = first_centroids(vectors, k, seed)
    sums = {(c, j): 0 for c in range(len(centres)) for j in range(-1, components)}
    table, changed, old = vectors.select("vec_id", "q", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")), list(range(len(centres))), None
    if not centres:
        return table, centres
    for round_ in range(rounds + 1):
        path = runtime.new_path(spark, f"centroids-{round_}")
        _assigned(table, centres, changed).write.partitionBy("moved").parquet(path)
        table = spark.read.schema(STATE).parquet(path)
        if old:
            runtime.remove(spark, old)
        old = path
        if round_ == rounds:
            break
        for c, j, total in transfers(table.filter("moved")).collect():  # at most k * (components + 1) rows
            sums[c, j] += int(total)
        now = [[sums[c, j] // sums[c, -1] for j in range(components)] if sums[c, -1] else centres[c] for c in range(len(centres))]
        changed = [c for c in range(len(centres)) if now[c] != centres[c]]
        centres = now
        if not changed:
            break
    return table.select("vec_id", "q", "cluster", "distance"), centres


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector of embeddings, with its cluster's and all clusters' inertia."""
    table, centres = cluster(runtime.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    sums = {r.cluster: int(r.total) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    held = lambda x: min(x, LONGEST)
    facts = [(c, held(sums.get(c, 0)), held(sum(sums.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres)]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance").join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Plain Lloyd in SQL: each round compares every vector with every centroid and adds all vectors up."""
    steps = [
        rf"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {COMPONENTS})""",
        f"x as materialized (select r, unnest(range(1, {COMPONENTS + 1})) as d, unnest(q) as a from v)",
        f"c0 as materialized (select k, unnest(range(1, {COMPONENTS + 1})) as d, unnest(q) as b from (select row_number() over (order by sha256('{SEED}:' || coalesce(cast(vec_id as varchar), '')), q) - 1 as k, q from v) where k < {CENTROIDS})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"e{n} as materialized (select r, k, sum((a - b) * (a - b)) as s from x join c{n} using (d) group by 1, 2)")
        steps.append(f"a{n} as materialized (select r, k, s from e{n} qualify row_number() over (partition by r order by s, k) = 1)")
        if n < ROUNDS:
            steps.append(f"m{n} as (select k, d, cast(sum(a) as bigint) as t, count(*) as n from a{n} join x using (r) group by 1, 2)")
            steps.append(f"c{n + 1} as materialized (select k, d, coalesce(t // n - case when t % n < 0 then 1 else 0 end, b) as b from c{n} left join m{n} using (k, d))")
    last = ROUNDS
    return "with " + ",\n".join(steps) + f""", h as (select k, sha256(string_agg(cast(b as varchar), ',' order by d)) as centroid_sha256 from c{last} group by 1)
select vec_id, cast(k as integer) as cluster, cast(s as bigint) as distance, cast(sum(s) over (partition by k) as bigint) as cluster_inertia, cast(sum(s) over () as bigint) as inertia, centroid_sha256
from a{last} join v using (r) join h using (k)"""


SQL = _sql()
