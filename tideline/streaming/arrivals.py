"""A log that arrives in deliveries, late and repeated rows among them, and sinks that are idempotent by batch number.

A delivery lands as files and is read as one batch by a stream that is started again from its checkpoint, so every query
over deliveries is also a restart for each of them. What a batch gives is written to a folder of its own number: a batch
that is run again after a stop replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import new_path

#: Deliveries of the registered queries, and how far a row may be behind the newest of those before.
DELIVERIES = 5
DELAY_DAYS = 3
MICROS = 1_000_000


def micros(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def deliveries(events: DataFrame, n: int = DELIVERIES) -> DataFrame:
    """Events with the delivery they come in: equal spans of time; some numbers come one or two later, some come again."""
    ends = events.filter("ts is not null and event_id is not null").agg(F.min(micros()).alias("lo"), F.max(micros()).alias("hi"))
    span = F.expr(f"cast({n} * (us - lo) div (hi - lo + 1) as int)")
    rows = events.filter("ts is not null and event_id is not null").withColumn("us", micros()).join(F.broadcast(ends))
    rows = rows.withColumn("on", F.expr("case when event_id % 29 = 0 then 2 when event_id % 13 = 0 then 1 else 0 end") + span)
    again = F.when(F.col("event_id") % 7 == 0, F.array(F.col("on"), F.col("on") + 1)).otherwise(F.array(F.col("on")))
    return rows.withColumn("delivery", F.explode(again)).withColumn("delivery", F.least("delivery", F.lit(n - 1))).select(*events.columns, "delivery").distinct()


def sql(source: str = "events") -> str:
    """The same in SQL, with what is late: a row at or below the newest of the deliveries before, less the delay, in whole ms."""
    return f"""source as (select * from {source} where ts is not null and event_id is not null),
 ends as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from source),
 placed as (select e.*, cast({DELIVERIES} * (epoch_us(ts) - lo) // (hi - lo + 1) as integer) + case when event_id % 29 = 0 then 2 when event_id % 13 = 0 then 1 else 0 end as place from source e, ends),
 landed as (select distinct * exclude (place, delivery), least(delivery, {DELIVERIES - 1}) as delivery from (select *, place as delivery from placed union all select *, place + 1 from placed where event_id % 7 = 0) x),
 newest as (select d as delivery, (select max(epoch_ms(ts)) from landed where landed.delivery < d) - {DELAY_DAYS * 86_400_000} as mark from (select unnest(range(0, {DELIVERIES} + 1)) as d) x),
 marked as (select landed.*, coalesce(epoch_us(ts) <= mark * 1000, false) as late from landed join newest using (delivery))"""


def read(landing: DataFrame, path: str) -> DataFrame:
    """The stream of what has landed at a path; event time is at."""
    return landing.sparkSession.readStream.schema(landing.schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def in_deliveries(rows: DataFrame, name: str, start: Callable[[str], DataStreamWriter], n: int = DELIVERIES, restarts: int = 0) -> tuple[str, list[dict]]:
    """Lands delivery after delivery, which are told apart once, and runs the stream that start makes for a base path until it has read each.

    A stream that fails is started again from its checkpoint, so many times in all. Returns the base path and the progress
    of all batches.
    """
    base, progress = new_path(rows.sparkSession, name), []
    rows.write.partitionBy("delivery").parquet(f"{base}/deliveries")
    told = rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/deliveries").select(*rows.columns)
    for k in range(n):
        told.filter(F.col("delivery") == k).write.mode("append").parquet(f"{base}/landing")
        while True:
            running = start(base).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            try:
                running.awaitTermination()
            except StreamingQueryException:
                if not restarts:
                    raise
                restarts -= 1
                continue
            progress += running.recentProgress
            break
    return base, progress


def by_batch(path: Callable[[int], str], make: Callable[[DataFrame, int], DataFrame] = lambda batch, _: batch) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch's rows replace what a run of the same batch has written before."""

    def keep(batch: DataFrame, number: int) -> None:
        make(batch, number).write.mode("overwrite").parquet(path(number))

    return keep


def rows_of(spark, base: str, schema: str) -> DataFrame:
    """What all batches have written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
