"""Exact order statistics of keys of any size: counts of ranges that narrow down, in place of a sorted key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path

#: Ranges into which the values that are still possible are cut in each round.
RANGES = 256


def nth(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(keys, rank, value): the value of each wanted rank (from 1) of each key; ranks has keys and rank.

    A round counts the values between the bounds known so far by range, with each range's smallest and largest value, and
    goes on in the range that holds the rank. It ends when all bounds have met: after at most a few rounds, since bounds are
    values that occur. Tasks add up counts only; no task sees a key's values in order. Null and NaN are no values.
    """
    spark = df.sparkSession
    base, round_ = new_path(spark, "quantiles"), 0
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    state = ranks.join(ends, list(keys)).filter(F.col("rank").between(1, F.col("_n"))).select(*keys, "rank", F.col("rank").cast("long").alias("_left"), "_lo", "_hi")
    while True:
        state.write.parquet(f"{base}/{round_}")
        state = spark.read.schema(state.schema).parquet(f"{base}/{round_}")
        if state.filter("_lo < _hi").isEmpty():
            return state.select(*keys, "rank", F.col("_lo").alias(value))
        inside = rows.join(state.filter("_lo < _hi"), list(keys)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # the bounds have ranges of their own, so what lies between shrinks even where the width is lost in rounding or endless
        share = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
        part = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), ranges).otherwise(F.least(F.floor(share * ranges), F.lit(ranges - 1))).cast("int")
        counts = inside.groupBy(*keys, "rank", "_left", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*keys, "rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        here = before.filter((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n"))).withColumn("_left", F.col("_left") - F.col("_before"))
        state = state.filter("_lo = _hi").unionByName(here.select(*state.columns))
        round_ += 1


def exclusive(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """(keys, value, n): the exclusive quantile: at place share * (n + 1) between two neighbours, kept within the values."""
    sizes = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = F.lit(share) * (F.col("n") + 1)
    low = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    placed = sizes.withColumn("_low", low).withColumn("_part", at - F.col("_low"))
    ranks = placed.select(*keys, F.explode(F.array("_low", F.least(F.col("_low") + 1, F.col("n")))).alias("rank")).distinct()
    found = nth(df, keys, value, ranks)
    pair = [found.select(*keys, F.col("rank").alias(r), F.col(value).alias(v)) for r, v in (("_low", "_a"), ("_high", "_b"))]
    rows = placed.withColumn("_high", F.least(F.col("_low") + 1, F.col("n"))).join(pair[0], [*keys, "_low"]).join(pair[1], [*keys, "_high"])
    return rows.select(*keys, (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias(value), "n")
