"""Substring search by an index of trigrams: which blocks of rows hold a needle's trigrams, and only those are read.

The index is two Parquet tables under a path. rows/ has the rows, in lower case, with a folder for each block (a hash of the
id, so blocks are of like size); grams/ has each trigram of lower-cased text, as a number, once for each block that holds it,
sorted by trigram, so that a look-up reads the row groups that its statistics allow. The number of blocks is a parameter; it bounds the folders and,
with the alphabet, the postings of a trigram.

A needle's trigrams select the blocks that hold all of them; the join on the block prunes the folders at run time, and each
row of those blocks is verified. A needle of fewer than three characters is looked for in all blocks. Null texts match
nothing; an empty needle matches every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 3
BLOCKS = 256


#: Bits of a character in a trigram's number; characters of text that are looked at together.
BITS = 21
PIECE = 1 << 20
#: Needles that a row meets at once.
TOGETHER = 128


def grams(text: Column) -> Column:
    """The distinct trigrams of a short text in lower case, as numbers of three characters of BITS bits."""
    small = F.lower(text)
    chars, n = F.split(small, ""), F.greatest(F.length(small) - SIZE + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice(chars, k + 1, n).alias(f"c{k}") for k in range(SIZE)))
    place = lambda x, k: F.shiftleft(F.ascii(x[f"c{k}"]).cast("long"), BITS * (SIZE - 1 - k))
    return F.array_distinct(F.transform(shifted, lambda x: place(x, 0).bitwiseOR(place(x, 1)).bitwiseOR(place(x, 2))))


def _grams_of_blocks(rows: DataFrame) -> DataFrame:
    """(gram, block) of rows (block, text in lower case), each once for what a task reads of a block at a time."""
    bits, piece = BITS, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}

        def told(block: int) -> pa.RecordBatch:
            found = seen.pop(block)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), block, np.int32))], names=["gram", "block"])

        for batch in batches:
            texts: dict[int, list[bytes]] = {}
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                texts.setdefault(block, []).append(text)
            for block, parts in texts.items():
                points = np.frombuffer(b"\0".join(parts).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                for at in range(0, max(len(points) - 2, 0), piece):
                    x = points[at : at + piece + 2].astype(np.int64)
                    own = np.unique(x[:-2] << 2 * bits | x[1:-1] << bits | x[2:])
                    seen[block] = np.union1d(seen[block], own) if block in seen else own
                if block in seen and len(seen[block]) > piece:
                    yield told(block)
            for block in [k for k in seen if k not in texts]:  # files are read block by block
                yield told(block)
        for block in list(seen):
            yield told(block)

    return rows.select("block", "text").filter("text is not null").mapInArrow(run, "gram long, block int")


def build(df: DataFrame, id_col: str, text_col: str, path: str, blocks: int = BLOCKS) -> None:
    """Writes the index of (id, text) to a path."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows.repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    pairs = _grams_of_blocks(df.sparkSession.read.parquet(f"{path}/rows")).distinct()
    pairs.repartitionByRange("gram").sortWithinPartitions("gram", "block").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, needles: DataFrame) -> DataFrame:
    """(needle, block): blocks in which each needle may stand."""
    asked = needles.select("needle").distinct().withColumn("grams", grams(F.col("needle"))).withColumn("n", F.size("grams"))
    known = spark.read.parquet(f"{path}/grams")
    long = asked.filter("n > 0").select("needle", "n", F.explode("grams").alias("gram")).join(known, "gram").groupBy("needle", "n", "block").agg(F.count(F.lit(1)).alias("found")).filter("found = n")
    every = spark.read.parquet(f"{path}/rows").select("block").distinct().agg(F.collect_list("block").alias("blocks"))  # as many as there are folders
    short = asked.filter("n = 0 and needle is not null").join(F.broadcast(every)).select("needle", F.explode("blocks").alias("block"))
    return long.select("needle", "block").unionByName(short)


def search(spark: SparkSession, path: str, needles: DataFrame) -> DataFrame:
    """(needle, id) of the rows whose text has the needle in it, upper and lower case alike.

    A row meets its block's needles in lists of TOGETHER, in Arrow batches.
    """
    rows = spark.read.parquet(f"{path}/rows").filter("text is not null").select("block", "id", "text")
    place = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("needle")) - 1) / TOGETHER)
    lists = candidates(spark, path, needles).withColumn("part", place).groupBy("block", "part").agg(F.collect_list("needle").alias("needles"))
    lists = lists.withColumn("small", F.transform("needles", F.lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[list, list]] = {}
        for batch in batches:
            keys, at, found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()), [], []
            for i, (key, text) in enumerate(zip(keys, batch.column(1).cast(pa.large_binary()).to_pylist())):
                if key not in known:
                    if len(known) > 16:
                        known.clear()
                    known |= {key: (batch.column(4)[i].as_py(), batch.column(5).slice(i, 1).flatten().cast(pa.large_binary()).to_pylist())}
                asked, small = known[key]
                for needle in [k for k, n in zip(asked, small) if n in text]:
                    at.append(i)
                    found.append(needle)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=["needle", "id"])

    pairs = rows.join(lists, "block").select("id", "text", "block", "part", "needles", "small")
    return pairs.mapInArrow(run, f"needle string, id {rows.schema['id'].dataType.simpleString()}")


def bytes_of(spark: SparkSession, path: str, blocks: list[int]) -> int:
    """Size of the folders of some blocks."""
    where = lambda b: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/block={b}")
    return sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in map(where, blocks))
