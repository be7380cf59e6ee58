"""One budget of characters over the parts of a text: minimums first, the remainder by priority, rows by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path, release

#: Ranges of row numbers by which sizes are added up, widest first.
SPANS = (10**9, 10**6, 10**3)
#: Lines of a key that one task adds up.
LARGE = 100_000


def running(rows: DataFrame, keys: list[str], at: str, size: str, limit: Column | int, name: str = "before") -> DataFrame:
    """Rows with the sum of the sizes before them within their key, in the order of a whole number; those at or over the limit go.

    Sizes are added up by ever smaller ranges of numbers, of which only those that begin below the limit are looked into, so a
    key that holds most rows is not added up by one task.
    """
    keys, base = list(keys), F.lit(0).cast("long")
    for k, span in enumerate(SPANS):
        rows = rows.withColumn(f"_part{k}", F.floor(F.col(at) / span))
        sums = rows.withColumn("_base", base).groupBy(*keys, f"_part{k}", "_base").agg(F.sum(size).alias("_sum"))
        before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(f"_part{k}").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("_base", F.col("_base") + F.coalesce(before, F.lit(0))).filter(F.col("_base") < limit).drop("_sum")
        keys = [*keys, f"_part{k}"]
        rows, base = rows.drop("_base").join(sums, keys), F.col("_base")
    own = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, F.col("_base") + own).filter(F.col(name) < limit).drop("_base", *(f"_part{k}" for k in range(len(SPANS))))


def allotted(sizes: DataFrame, key: str, part: str, budget: int, least: int) -> DataFrame:
    """(key, part, size) with what each part gets: up to `least` each, then what is left to the first that ask for more.

    The parts of a key are few. least times the number of parts must not be over the budget.
    """
    sure = F.least(F.col("size"), F.lit(least))
    by_key = Window.partitionBy(key)
    asked = F.coalesce(F.sum(F.col("size") - sure).over(by_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.lit(budget) - F.sum(sure).over(by_key)
    return sizes.withColumn("allotted", sure + F.greatest(F.lit(0), F.least(F.col("size") - sure, rest - asked)))


def within(lines: DataFrame, key: str, part: str, at: str, budget: int, least: int) -> DataFrame:
    """Rows with the sum of _size before them in their part, and what `allotted` gives the part: one shuffle, by key."""
    of_part = Window.partitionBy(key, part)
    rows = lines.repartition(key).withColumn("before", F.coalesce(F.sum("_size").over(of_part.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_whole", F.sum("_size").over(of_part))
    first = F.row_number().over(of_part.orderBy(at)) == 1
    rows = rows.withColumn("_first", first)
    sure = F.least("_whole", F.lit(least))
    more = F.col("_whole") - sure
    asked = F.coalesce(F.sum(F.when(F.col("_first"), more)).over(Window.partitionBy(key).orderBy(part, at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.when(F.col("_first"), 0).otherwise(more)
    rest = F.lit(budget) - F.sum(F.when(F.col("_first"), sure)).over(Window.partitionBy(key))
    return rows.withColumn("allotted", sure + F.greatest(F.lit(0), F.least(more, rest - asked))).drop("_whole", "_first")


def bundles(lines: DataFrame, key: str, part: str, at: str, line: str, budget: int, least: int, large: int = LARGE) -> DataFrame:
    """(key, text, n_parts): the lines of each key's parts in order, each with a line break, as far as each part's allotment goes.

    The lines are written to the shared folder first. Keys of at most `large` lines are shuffled once; for those of more, each range
    of places is a pass over their lines. A null line is an empty one. No text is longer than the budget: what is collected for a key is at most so many characters.
    """
    spark = lines.sparkSession
    whole = lines.select(key, part, at, F.concat(F.coalesce(line, F.lit("")), F.lit("\n")).alias("_line")).withColumn("_size", F.length("_line").cast("long"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    whole = kept(whole, "bundles")
    crowded = kept(whole.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).select(key), "bundles-crowded")
    release(spark)
    if crowded.isEmpty():
        rows = within(whole, key, part, at, budget, least)
    else:
        many = whole.join(crowded, key, "left_semi")
        shares = allotted(many.groupBy(key, part).agg(F.sum("_size").alias("size")), key, part, budget, least)
        ranged = running(many, [key, part], at, "_size", budget).join(shares.select(key, part, "allotted"), [key, part])
        rows = within(whole.join(crowded, key, "left_anti"), key, part, at, budget, least).unionByName(ranged)
    rows = rows.filter(F.col("before") < F.col("allotted"))
    rows = rows.withColumn("_line", F.substring("_line", F.lit(1), (F.col("allotted") - F.col("before")).cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct(part, at, "_line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "").alias("text"), F.count_distinct(part).alias("n_parts"))
