"""Event logs: tails, notifications, retention, failures in a row, staleness, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.adapter import table
from .catalog import query

AT = "2024-01-20 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@query(f"select user_id, max(ts) as last_seen, max(ts) < timestamp '{AT}' - interval 300 second as dead, max(ts) < timestamp '{AT}' - interval 120 second as stale from events where ts <= timestamp '{AT}' group by 1")
def stale_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").filter(F.col("ts") <= _at()).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.select("user_id", "last_seen", (F.col("last_seen") < _at() - F.expr("interval 300 seconds")).alias("dead"), (F.col("last_seen") < _at() - F.expr("interval 120 seconds")).alias("stale"))


@query(f"select event_id, ts, event_type from events where user_id = 7 and event_id > 500 order by event_id limit 200")
def log_tail(spark, sf):
    """The next page of a log after a mark; the filter reaches the scan."""
    return R.top(table(spark, sf, "events").filter("user_id = 7 and event_id > 500"), [F.col("event_id")], 200).select("event_id", "ts", "event_type")


@query(f"select distinct event_id, ts, event_type from (select * from events union all select * from events where event_id % 10 = 0) where ts > timestamp '{AT}'")
def chronicle_tail(spark, sf):
    """New events after a mark, each once though it may be read again."""
    rows = table(spark, sf, "events")
    return rows.unionByName(rows.filter("event_id % 10 = 0")).filter(F.col("ts") > _at()).dropDuplicates(["event_id"]).select("event_id", "ts", "event_type")


@query("select event_id, user_id, event_type from (select * from events where event_type in ('error', 'purchase') qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) where (user_id, event_type) not in (select user_id, event_type from events where event_type = 'error' and event_id % 100 = 0)")
def notification_dedupe(spark, sf):
    """What is raised: the first of each key, where none is open already."""
    rows = table(spark, sf, "events")
    return R.insert_absent(rows.filter("event_type = 'error' and event_id % 100 = 0"), rows.filter("event_type in ('error', 'purchase')"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("select user_id, event_type as state, case event_type when 'error' then 'blocked' when 'view' then 'waiting_review' when 'purchase' then 'task_closed' end as open_event from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def notification_state(spark, sf):
    """Every transition closes what was open; the latest alone decides what is open now."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.withColumn("open_event", F.expr("case state when 'error' then 'blocked' when 'view' then 'waiting_review' when 'purchase' then 'task_closed' end"))


@query(f"select event_id, case when ts < timestamp '{AT}' - interval 7 day then 'deleted' when ts <= timestamp '{AT}' - interval 3 day then 'payload_purged' else 'kept' end as fate, case when ts > timestamp '{AT}' - interval 3 day then props end as payload from events")
def retention_split(spark, sf):
    """Old rows go (strictly before the limit); expired payloads go (at the limit too) while their rows stay."""
    ts = F.col("ts")
    fate = F.when(ts < _at() - F.expr("interval 7 days"), "deleted").when(ts <= _at() - F.expr("interval 3 days"), "payload_purged").otherwise("kept")
    return table(spark, sf, "events").select("event_id", fate.alias("fate"), F.when(ts > _at() - F.expr("interval 3 days"), F.col("props")).alias("payload"))


@query("select user_id, count(*) as denials from events where event_type = 'error' group by 1 having count(*) >= 2")
def denials_over_threshold(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("denials")).filter("denials >= 2")


CIRCUIT_SQL = """with i as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) as island from events where event_type in ('error', 'purchase', 'signup')),
  r as (select user_id, island, count(*) filter (where event_type <> 'purchase') as failures, max(ts) as last_ts from i group by 1, 2)"""


@query(f"{CIRCUIT_SQL} select user_id, failures, failures >= 3 and last_ts > timestamp '2024-01-25' - interval 10 minute as paused from r qualify row_number() over (partition by user_id order by island desc) = 1")
def circuit_state(spark, sf):
    """Failures in a row since the last success, and whether the circuit is open; one aggregate by island, then the last."""
    rows = table(spark, sf, "events").filter("event_type in ('error', 'purchase', 'signup')")
    runs = R.islands(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase").groupBy("user_id", "island").agg(F.count_if(F.col("event_type") != "purchase").alias("failures"), F.max("ts").alias("last_ts"))
    last = runs.groupBy("user_id").agg(F.max_by(F.struct("failures", "last_ts"), "island").alias("x"))
    return last.select("user_id", "x.failures", ((F.col("x.failures") >= 3) & (F.col("x.last_ts") > F.lit("2024-01-25").cast("timestamp_ntz") - F.expr("interval 10 minutes"))).alias("paused"))


@query(f"{CIRCUIT_SQL} select user_id, cast(max(failures) as bigint) as longest from r group by 1")
def longest_failure_run(spark, sf):
    rows = table(spark, sf, "events").filter("event_type in ('error', 'purchase', 'signup')")
    runs = R.islands(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase").groupBy("user_id", "island").agg(F.count_if(F.col("event_type") != "purchase").alias("failures"))
    return runs.groupBy("user_id").agg(F.max("failures").alias("longest"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.nothing') as nothing from events")
def report_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.nothing").alias("nothing"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, count(distinct user_id) as users from events group by 1, 2")
def daily_activity(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("select user_id, count(*) as sessions, cast(max(n) as bigint) as longest from (select user_id, s, count(*) as n from (select user_id, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour then 1 else 0 end as fresh from events)) group by 1, 2) group by 1")
def activity_sessions(spark, sf):
    """Extra: stretches of events without a gap of over six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, sf, "events").withColumn("prior", F.lag("ts").over(w)).withColumn("fresh", F.col("prior").isNull() | (micros("ts") - micros("prior") > 6 * 3600 * 1_000_000))
    runs = R.islands(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("fresh")).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
