"""What the corpus operators share: reading tables, the executors' import path, materialised tables, row-wise kernels."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch are worked through in slices of at most so many bytes of text, which bounds a kernel's memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Rows of one Arrow batch, at most: texts are long, and a batch is held by the JVM and by Python at the same time.
BATCH_ROWS = 1000


def python_path(spark: SparkSession) -> None:
    """Executors started without this package on their path find it where the driver has it; batches have BATCH_ROWS rows at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it.

    Where it is unset a folder beside the warehouse is used if all runs on this machine; a cluster has to name one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return known.rstrip("/") if known else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans whose rows have been written and that nothing refers to.

    The last plan that ran is referred to until another one has run, and by the listeners' queue until its end has been
    told to them.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.java.lang.System.gc()


def slices(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def octets(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named in_0, in_1, ... by place, so that no name of an operator's own can clash with them."""
    return df.toDF(*(f"in_{i}" for i in range(len(df.columns))))


def map_rows(df: DataFrame, keep: list[str], text: str, kernel: Callable[[list[bytes]], dict[str, list]], schema: str) -> DataFrame:
    """One row for each row of df: the columns of keep as they are, then what kernel makes of a list of texts.

    kernel gets UTF-8 texts (null as empty) and returns a list for each column of schema after keep's. Nothing is
    carried from one slice to the next, so any task can run again anywhere.
    """
    python_path(df.sparkSession)
    rows = numbered(df.select(*map(column, keep), column(text)))
    n = len(keep)
    kept = rows.select(*rows.columns[:n]).schema
    made_types = [(x.strip().split(" ")[0], TYPES[x.strip().split(" ")[1]]) for x in schema.split(",")]
    whole = pa.schema([*to_arrow_schema(kept), *(pa.field(m, t) for m, t in made_types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                made = kernel(octets(part.column(n)))
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(whole.field(i).type) for i in range(n)), *(pa.array(made[m], type=t) for m, t in made_types)], schema=whole)

    made = StructType.fromDDL(schema).fields
    return rows.mapInArrow(run, StructType([*kept.fields, *made])).toDF(*keep, *(f.name for f in made))


def with_made(df: DataFrame, text: str, kernel: Callable[[list[bytes]], dict[str, list]], schema: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use() of all rows of df with the kernel's columns beside them, and of that df's columns only, under their own names.

    In between df's columns go by numbered names: names that clash with the kernel's, or that need quotes, do no harm.
    """
    rows = numbered(df)
    made = map_rows(rows, rows.columns, f"in_{df.columns.index(text)}", kernel, schema)
    return use(made).select(*rows.columns).toDF(*df.columns)


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def quoted(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
