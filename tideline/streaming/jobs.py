"""Streams over the event log: they run until what is there is read, and their last state comes back as a table.

State is kept by Spark with checkpoints in the shared folder. Event time is a timestamp with a zone; the log's own is
without, so it is cast at the source. Files come in any order and a batch holds a few of them, so no stream drops late
events: state stays for as long as the stream runs, and its size is stated with each stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import new_path


def source(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a single file is not a folder to watch: its folder is, narrowed to its name; a folder of parts is watched as it is
    path, name = sf.rstrip("/"), "events.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return reader.option("pathGlobFilter", name).parquet(path) if _is_file(spark, f"{path}/{name}") else reader.parquet(f"{path}/{name}")


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def drained(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there. In update mode the last row of each key is what counts."""
    spark = stream.sparkSession
    base = new_path(spark, name)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/{number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("x"))
    return last.select("x.*")


def deduplicated_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events but views, each once, however late; the state holds every event number."""
    once = source(spark, sf).filter("event_type <> 'view'").dropDuplicates(["event_id"])
    return drained(once.select("event_id", "user_id", "ts", "event_type"), "append", "log")


def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = source(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"))
    return drained(rows, "update", "seen", ["user_id"])


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour, however late an event; the state holds a row for each window and type."""
    rows = source(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    sums = rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("total"))
    return drained(sums.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), "update", "hourly", ["hour", "event_type"])


def live_channel(spark: SparkSession, sf: str, user: int) -> DataFrame:
    """Three logs of one task as one stream: runs, their log lines, and the chronicle, each event once; the state holds its event numbers."""
    kinds = {"run": "event_type in ('signup', 'purchase')", "log": "event_type in ('view', 'click')", "chronicle": "event_type = 'error'"}
    parts = [source(spark, sf).filter(F.col("user_id") == user).filter(which).select("event_id", "ts", F.lit(kind).alias("channel")) for kind, which in kinds.items()]
    return drained(parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["event_id"]), "append", "live")


def beats(spark: SparkSession, sf: str, patience: str = "300 seconds") -> DataFrame:
    """Users that were last heard of so long before the newest event of all that they count as lost; state by user."""
    rows = source(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    seen = drained(rows, "update", "beats", ["user_id"])
    newest = seen.agg(F.max("last_seen").alias("newest"))
    return seen.crossJoin(F.broadcast(newest)).select("user_id", "last_seen", (F.col("last_seen") < F.col("newest") - F.expr(f"interval {patience}")).alias("lost"))


def pauses(spark: SparkSession, sf: str, as_of: str, most: int = 3) -> DataFrame:
    """Circuits that are open: failures in a row since the last success, and whether the last of them is within ten minutes.

    The pause ends by being read after that, not by a timer. The state by user is that of failures_in_a_row.
    """
    counts = failures_in_a_row(spark, sf)
    last = drained(source(spark, sf).filter("event_type in ('error', 'signup')").groupBy("user_id").agg(F.max("ts").alias("last_failure")), "update", "pauses", ["user_id"])
    open_until = F.col("last_failure") + F.expr("interval 10 minutes")
    return counts.join(last, "user_id", "left").select("user_id", "failures", ((F.col("failures") >= most) & (open_until > F.lit(as_of).cast("timestamp_ntz"))).alias("paused"))


def failures_in_a_row(spark: SparkSession, sf: str) -> DataFrame:
    """Failures since the last success by event number, in whatever order events come; null numbers count as last.

    The state by user holds the last success and the numbers of the failures after it, so a late event finds its place.
    """
    schema = "user_id long, failures long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, after = state.get if state.exists else (None, [])
        after = list(after)
        for p in parts:
            good = p["event_type"] == "purchase"
            wins = p["event_id"][good]
            if len(wins):
                last = int(wins.max()) if last is None else max(last, int(wins.max()))
            after += p["event_id"][~good].tolist()
        after = [int(x) for x in after if last is None or x > last]
        state.update((last, after))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [len(after)]})

    number = F.coalesce("event_id", F.lit((1 << 63) - 1)).cast("long").alias("event_id")
    rows = source(spark, sf).filter("event_type in ('error', 'purchase', 'signup')").select("user_id", number, "event_type")
    counted = rows.groupBy("user_id").applyInPandasWithState(step, schema, "last long, after array<long>", "update", GroupStateTimeout.NoTimeout)
    return drained(counted, "update", "circuit", ["user_id"])
