"""What is written, and streams: every sink and stream here is read back so that its rows can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.adapter import table
from ..streaming import changes, heartbeats, jobs, tail
from .catalog import query


@query("select coalesce(b.k, a.k) as user_id, coalesce(b.v, a.v) as last_value from (select user_id as k, arg_max(value, event_id) as v from events where event_id <= 500 group by 1) a full join (select user_id as k, arg_max(value, event_id) as v from events where event_id > 500 group by 1) b on a.k = b.k")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Heartbeats and settings: new values replace old ones, unknown keys are added."""
    rows = table(spark, sf, "events")
    last = lambda cond: rows.filter(cond).groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))
    return R.upsert(last("event_id <= 500"), last("event_id > 500"), ["user_id"])


@query("""with defaults as (select concat(lower(s.c_mktsegment), '.', cast(n_nationkey as varchar)) as setting, n_regionkey as base from nation, (select distinct c_mktsegment from customer) s), stored as (select concat(lower(c_mktsegment), '.', cast(c_nationkey as varchar)) as setting, arg_max(c_custkey, c_custkey) as own from customer where c_acctbal > 5000 group by 1)
  select setting, cast(coalesce(own, base) as varchar) as value, own is null as by_default from defaults left join stored using (setting)""")
def settings_with_defaults(spark, sf):
    """Stored settings over their defaults: the last stored value of a name, else its default."""
    kinds = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("kind")).distinct().agg(F.collect_set("kind").alias("kinds"))  # five kinds
    defaults = table(spark, sf, "nation").join(F.broadcast(kinds)).select(F.explode("kinds").alias("kind"), "n_nationkey", "n_regionkey").select(F.concat_ws(".", "kind", F.col("n_nationkey").cast("string")).alias("setting"), F.col("n_regionkey").cast("string").alias("base"))
    name = F.concat_ws(".", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    stored = table(spark, sf, "customer").filter("c_acctbal > 5000").groupBy(name.alias("setting")).agg(F.max("c_custkey").cast("string").alias("own"))
    return defaults.join(stored, "setting", "left").select("setting", F.coalesce("own", "base").alias("value"), F.col("own").isNull().alias("by_default"))


@query("select i as n, concat('generated ', cast(i as varchar), ' of ', r_name) as title from region, range(1, 1001) t(i) where r_regionkey = i % 5")
def row_generator(spark, sf):
    regions = table(spark, sf, "region")
    return spark.range(1, 1001).join(F.broadcast(regions), F.col("id") % 5 == F.col("r_regionkey")).select(F.col("id").alias("n"), F.format_string("generated %d of %s", "id", "r_name").alias("title"))


@query("select event_type from events where event_type not in (select unnest(['view', 'click'])) group by 1 having count(*) > 0")
def orphan_tags(spark, sf):
    """Tags that nothing refers to."""
    used = spark.createDataFrame([("view",), ("click",)], "event_type string")
    return table(spark, sf, "events").select("event_type").distinct().join(used, "event_type", "left_anti")


@query("select event_id, user_id, ts, event_type from events where event_type <> 'view'")
def log_tail_stream(spark, sf):
    """The log as a stream: each event once, though files may repeat it; the mark is the checkpoint."""
    return jobs.deduplicated_log(spark, sf)


@query("select user_id, max(ts) as last_seen, count(*) as events from events group by 1")
def activity_stream(spark, sf):
    """State by user kept by a stream, its last state read back."""
    return jobs.last_seen(spark, sf)


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, cast(sum(floor(value)) as bigint) as total from events group by 1, 2")
def windowed_counts_stream(spark, sf):
    """Extra: tumbling windows over event time; late events count, so each window's state stays."""
    return jobs.hourly(spark, sf)


@query("with i as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as island from events where event_type in ('error', 'purchase', 'signup')), r as (select user_id, island, count(*) filter (where event_type <> 'purchase') as n from i group by 1, 2) select user_id, n as failures from r qualify row_number() over (partition by user_id order by island desc) = 1")
def circuit_stream(spark, sf):
    """Failures in a row as state of a stream, by event number."""
    return jobs.failures_in_a_row(spark, sf)


@query("select event_id, ts, case when event_type in ('signup', 'purchase') then 'run' when event_type in ('view', 'click') then 'log' else 'chronicle' end as channel from events where user_id = 8")
def live_channel_stream(spark, sf):
    """One task's runs, log lines and chronicle as they come."""
    return jobs.live_channel(spark, sf, 8)


@query("select user_id, max(ts) as last_seen, max(ts) < (select max(ts) from events) - interval 300 second as lost from events group by 1")
def heartbeat_stream(spark, sf):
    """Who has not been heard of for longer than is allowed."""
    return jobs.beats(spark, sf)


@query("""with i as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as island from events where event_type in ('error', 'purchase', 'signup')), r as (select user_id, island, count(*) filter (where event_type <> 'purchase') as n from i group by 1, 2),
  f as (select user_id, max(ts) as last from events where event_type in ('error', 'signup') group by 1)
  select r.user_id, n as failures, coalesce(n >= 3 and last + interval 10 minute > timestamp '2024-01-28', n >= 3 and null) as paused from r left join f using (user_id) qualify row_number() over (partition by r.user_id order by island desc) = 1""")
def circuit_pauses_stream(spark, sf):
    """Open circuits; a pause has an end."""
    return jobs.pauses(spark, sf, "2024-01-28")


@query(heartbeats.SQL)
def lost_runs_stream(spark, sf):
    """Runs that end by a report or by a timer, and whether that frees their task; the log comes late and repeats rows."""
    return heartbeats.lost_runs(table(spark, sf, "events"))[0]


@query(tail.SQL)
def late_tail_stream(spark, sf):
    """Each event once while it is on time; what comes too late is in the side table."""
    return tail.followed(table(spark, sf, "events"))[0]


@query(changes.SQL)
def activity_changes_stream(spark, sf):
    """Lines of server-sent events: a task's activity whenever it has changed, and the end marker."""
    return changes.watched(table(spark, sf, "events"))[0]
