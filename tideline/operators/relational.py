"""Set-based forms of what a workflow system does row by row: latest, last n, distinct on, upserts, diffs, claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def first_per(df: DataFrame, keys: Sequence[str], order: Order, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order that must be total; the rank is kept under the given name."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def top(df: DataFrame, order: Order, n: int, offset: int = 0) -> DataFrame:
    """A page in a total order: each task keeps offset + n rows, one merges them."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win over old ones with the same key, column by column where they are not null."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns))


def diff(before: DataFrame, after: DataFrame, key: str, mark: str) -> DataFrame:
    """Key and change: added, removed, updated or same, by a digest column."""
    a, b = before.select(F.col(key), F.col(mark).alias("was")), after.select(F.col(key), F.col(mark).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def insert_absent(open_rows: DataFrame, new: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Rows of new to append: the first of each key that has no open row yet."""
    return first_per(new.join(open_rows.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def numbered(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Order, name: str = "number") -> DataFrame:
    """df with each row's number within its key, from 1, in an order that must be total.

    coarse are columns that never fall along the order, such as ranges of ids. Rows are numbered within a key and a range;
    what comes before a range is a running sum over the ranges' counts. So a key that holds most rows is many tasks' work.
    """
    parts = [f"_part{i}" for i in range(len(coarse))]
    rows = df.select("*", *(c.alias(p) for c, p in zip(coarse, parts)))
    w = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, *parts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order)))
    return rows.join(before, [*keys, *parts]).withColumn(name, F.col("_before") + F.col("_own")).drop(*parts, "_before", "_own")


def next_versions(known: DataFrame, new: DataFrame, keys: Sequence[str], order: Order, version: str = "version", coarse: Sequence[Column] = ()) -> DataFrame:
    """New rows with the versions that follow the highest known of their key; coarse as in numbered."""
    latest = known.groupBy(*keys).agg(F.max(version).alias("_last"))
    rows = numbered(new, keys, coarse or [F.lit(0)], order, "_number")
    return rows.join(latest, list(keys), "left").withColumn(version, F.coalesce("_last", F.lit(0)) + F.col("_number")).drop("_last", "_number")


def claims(asked: DataFrame, item: str, order: Order) -> DataFrame:
    """Each item goes to the first claim on it: the set-based form of compare-and-set."""
    return asked.withColumn("won", F.row_number().over(Window.partitionBy(item).orderBy(*order)) == 1)


def islands(df: DataFrame, keys: Sequence[str], order: Order, breaks: Column) -> DataFrame:
    """df with island: how many breaking rows came before or at a row. Rows between breaks share a number."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def closure(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Nodes reachable from start (column node) over edges (a, b) within `most` steps; for small graphs."""
    seen = start.select("node").distinct()
    for _ in range(most):
        seen = seen.unionByName(seen.join(edges, seen["node"] == edges["a"]).select(F.col("b").alias("node"))).distinct()
    return seen
