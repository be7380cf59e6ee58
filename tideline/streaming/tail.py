"""The tail of a log with a stated lateness: what is on time is told once, what is too late goes to a table of its own.

On time is a row above the watermark, the newest time of the batches before less the delay. Those go through
dropDuplicatesWithinWatermark, whose state holds event numbers of the last delay only. Rows at or below the watermark,
which Spark leaves out of the state, are kept in a side table with how late they are: the same batch is read beside, and
each batch leaves its newest time for the next in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrivals

ROWS = "event_id long, user_id long, ts timestamp_ntz, event_type string, delivery int, told boolean"


def followed(events: DataFrame, delay_days: int = arrivals.DELAY_DAYS, n: int = arrivals.DELIVERIES) -> tuple[DataFrame, list[dict]]:
    """Rows told once, and rows too late, of a log that arrives in n deliveries; and the batches' progress."""
    spark = events.sparkSession
    landed = arrivals.deliveries(events, n)
    columns = [x.split(" ")[0] for x in ROWS.split(", ")]
    water = "newest long"

    def start(base: str):
        told = arrivals.read(landed, f"{base}/landing").withWatermark("at", f"{delay_days} days").dropDuplicatesWithinWatermark(["event_id"]).withColumn("told", F.lit(True))
        seen = arrivals.read(landed, f"{base}/landing").withColumn("told", F.lit(False))

        def keep(batch: DataFrame, number: int) -> None:
            batch.persist()
            try:
                before = spark.read.schema(water).parquet(f"{base}/water/{number - 1}").first().newest if number else None  # one row
                newest = F.lit(before).cast("long")
                late = F.coalesce(arrivals.micros() <= (newest - delay_days * 86_400_000) * 1000, F.lit(False))
                batch.filter("told").select(*columns).write.mode("overwrite").parquet(f"{base}/rows/told/{number}")
                batch.filter(~F.col("told") & late).select(*columns).write.mode("overwrite").parquet(f"{base}/rows/late/{number}")
                batch.agg(F.greatest(F.max(F.unix_millis("at")), newest).alias("newest")).write.mode("overwrite").parquet(f"{base}/water/{number}")
            finally:
                batch.unpersist()

        return told.unionByName(seen).writeStream.foreachBatch(keep)

    base, progress = arrivals.in_deliveries(landed, "tail", start, n)
    return arrivals.rows_of(spark, f"{base}/rows", ROWS), progress


SQL = f"""with {arrivals.sql()}
select event_id, user_id, ts, event_type, min(delivery) as delivery, true as told from marked where not late group by event_id, user_id, ts, event_type
union all select event_id, user_id, ts, event_type, delivery, false from marked where late"""
