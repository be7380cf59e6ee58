"""Relations followed to their end: all that is reachable, in rounds that grow with the logarithm of the longest way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, release


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, steps): every node b that can be reached from a, by the fewest steps; and the number of rounds.

    A round knows all ways of up to n fewest steps and joins those of exactly n with all of them, end to start: a shortest way
    of more than n and up to 2n steps begins with one of exactly n and goes on with a known one, so no way is put together
    at more than one place. It ends when no way has n steps. A node on a cycle reaches itself. Each round's new ways are a
    table in the shared folder. Edges with a null end lead nowhere; repeated ones count once.
    """
    spark: SparkSession = edges.sparkSession
    base, rounds, steps = new_path(spark, "reachable"), 0, 1
    new = _kept(edges.select("a", "b").filter("a is not null and b is not null").distinct().withColumn("steps", F.lit(1)), f"{base}/0")
    ways = new
    while True:
        rounds += 1
        far = new.filter(F.col("steps") == steps)
        if far.isEmpty():
            return ways, rounds
        longer = far.alias("x").join(ways.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.steps") + F.col("y.steps")).alias("steps"))
        new = _kept(longer.groupBy("a", "b").agg(F.min("steps").alias("steps")).join(ways, ["a", "b"], "left_anti"), f"{base}/{rounds}")
        ways, steps = ways.unionByName(new), 2 * steps
        release(spark)


def chains(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, steps, cyclic) for nodes with one link each (a to b): how many nodes follow, without a table of pairs; and the rounds.

    Pointer doubling on one row a node: it points 2 ** k nodes on, or nowhere. A chain of n nodes is done after log2(n) rounds;
    what still points somewhere when a round ends no more of them runs into a cycle, which has no number of steps (null).
    """
    spark = links.sparkSession
    base, rounds = new_path(spark, "chains"), 0
    links = links.filter("a is not null and b is not null").groupBy("a").agg(F.min("b").alias("b"))
    ends = links.select(F.col("b").alias("a")).distinct().join(links, "a", "left_anti").select("a", F.lit(None).cast(links.schema["b"].dataType).alias("b"), F.lit(0).cast("long").alias("steps"))
    state = _kept(links.withColumn("steps", F.lit(1).cast("long")).unionByName(ends), f"{base}/0")
    open_ = state.filter("b is not null").count()
    while open_:
        rounds += 1
        ahead = state.select(F.col("a").alias("b"), F.col("b").alias("beyond"), F.col("steps").alias("more"))
        state = _kept(state.join(ahead, "b", "left").select("a", F.col("beyond").alias("b"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), f"{base}/{rounds}")
        left = state.filter("b is not null").count()
        if left == open_:
            break
        open_ = left
    cyclic = F.col("b").isNotNull()
    return state.select(F.col("a").alias("node"), F.when(~cyclic, F.col("steps")).alias("steps"), cyclic.alias("cyclic")), rounds
