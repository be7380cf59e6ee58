"""Runs: tokens, retries, budgets, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.adapter import table
from .catalog import query

AS_OF = "1998-06-01 12:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("select task_id, cast(sum(input_tokens) as bigint) as input, cast(sum(output_tokens) as bigint) as output, cast(sum(cache_tokens) as bigint) as cache from run group by 1", ("run",))
def token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "run").groupBy("task_id").agg(*(F.sum(f"{k}_tokens").alias(k) for k in ("input", "output", "cache")))


@query("select user_id, arg_max(value, event_id) as value, max(event_id) as last_event from events group by 1")
def usage_last_write_wins(spark, sf):
    """Cumulative counters: the last one counts, sums would count twice."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("last_event"))


LATEST = "started_at desc, attempt_no desc, session_id desc, input_tokens desc, output_tokens desc"


def _latest() -> list:
    return [F.desc(x.split()[0]) for x in LATEST.split(", ")]


@query(f"select task_id, agent_id, outcome, started_at, attempt_no from run qualify row_number() over (partition by task_id, agent_id order by {LATEST}) = 1", ("run",))
def latest_run_per_pair(spark, sf):
    return R.first_per(table(spark, sf, "run"), ["task_id", "agent_id"], _latest()).select("task_id", "agent_id", "outcome", "started_at", "attempt_no")


@query("select event_type, detail, ts from (select *, concat(event_type, ' ', cast(user_id % 13 as varchar)) as detail from events where event_type in ('error', 'view')) qualify row_number() over (partition by detail order by ts desc, event_id desc) = 1 order by detail limit 3")
def failure_causes_top3(spark, sf):
    """The three first causes by text, each with its newest time: as the scheduler shows them."""
    rows = table(spark, sf, "events").filter("event_type in ('error', 'view')").withColumn("detail", F.left(F.concat_ws(" ", "event_type", (F.col("user_id") % 13).cast("string")), F.lit(120)))
    newest = rows.groupBy("detail").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x"))
    return newest.select("x.event_type", "detail", "x.ts").orderBy("detail").limit(3)


@query(f"""+ last as (select * from run qualify row_number() over (partition by task_id order by {LATEST}) = 1)
  select task_id, retry_count, cast([1, 5, 15][case when outcome in ('interrupted', 'success') then 3 else least(greatest(retry_count, 1), 3) end] as bigint) as pause,
  epoch_us(timestamp '{AS_OF}') - epoch_us(coalesce(finished_at, started_at)) >= 60000000 * cast([1, 5, 15][case when outcome in ('interrupted', 'success') then 3 else least(greatest(retry_count, 1), 3) end] as bigint) as due from last join task using (task_id)""", ("task", "run"))
def retry_eligibility(spark, sf):
    """The pause after a run: the longest after an interruption or no progress, else by attempt; and whether it is over."""
    ladder = F.array(*map(F.lit, (1, 5, 15)))
    last = R.first_per(table(spark, sf, "run"), ["task_id"], _latest())
    step = F.when(F.col("outcome").isin("interrupted", "success"), F.size(ladder)).otherwise(F.least(F.greatest("retry_count", F.lit(1)), F.size(ladder)))
    rows = last.join(table(spark, sf, "task").select("task_id", "retry_count"), "task_id").withColumn("pause", F.element_at(ladder, step).cast("long"))
    since = F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.coalesce("finished_at", "started_at").cast("timestamp"))
    return rows.select("task_id", "retry_count", "pause", (since >= F.col("pause") * 60_000_000).alias("due"))


@query("select task_id, count(*) as runs, count(*) >= 3 as over, count(*) between 2 and 2 as near from run join task using (task_id) where (reason_code is null or reason_code not in ('soft_turns', 'stale_status')) and (runs_reset_at is null or started_at > runs_reset_at) group by 1", ("task", "run"))
def run_budget(spark, sf):
    """Runs that count: not of a soft kind, and after the last reset."""
    runs = table(spark, sf, "run").filter(F.col("reason_code").isNull() | ~F.col("reason_code").isin("soft_turns", "stale_status"))
    rows = runs.join(table(spark, sf, "task").select("task_id", "runs_reset_at"), "task_id").filter(F.col("runs_reset_at").isNull() | (F.col("started_at") > F.col("runs_reset_at")))
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("runs")).select("task_id", "runs", (F.col("runs") >= 3).alias("over"), (F.col("runs") == 2).alias("near"))


@query(f"select task_id, reason_code, reason_code is distinct from 'provider_unreachable' as burns from run where outcome = 'failed' qualify row_number() over (partition by task_id order by {LATEST}) = 1", ("run",))
def last_failure_code(spark, sf):
    last = R.first_per(table(spark, sf, "run").filter("outcome = 'failed'"), ["task_id"], _latest())
    return last.select("task_id", "reason_code", (~F.col("reason_code").eqNullSafe("provider_unreachable")).alias("burns"))


@query(f"""select task_id, session_id from run where outcome = 'failed' and reason_code in ('turns_limit', 'timeout_work') and finished_at is not null and epoch_us(finished_at) - epoch_us(started_at) < 900000000
  qualify row_number() over (partition by task_id order by {LATEST}) = 1""", ("run",))
def session_resume(spark, sf):
    """Sessions that may go on: failed by a limit within a quarter of an hour."""
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    rows = table(spark, sf, "run").filter("outcome = 'failed' and reason_code in ('turns_limit', 'timeout_work') and finished_at is not null").filter(took < 900_000_000)
    return R.first_per(rows, ["task_id"], _latest()).select("task_id", "session_id")


@query("""select o_custkey as project, o_orderpriority as kind, o_orderkey as task_id, version from (select *, dense_rank() over (partition by o_custkey, o_orderpriority order by o_orderdate) as version from orders)
  qualify version = max(version) over (partition by o_custkey, o_orderpriority)""")
def latest_version_per_kind(spark, sf):
    """All rows of the latest version of each kind; ties stay."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("task_id"), "o_orderdate")
    w = R.Window.partitionBy("project", "kind").orderBy("o_orderdate")
    numbered = rows.withColumn("version", F.dense_rank().over(w).cast("long"))
    last = numbered.groupBy("project", "kind").agg(F.max("version").alias("version"))
    return numbered.join(last, ["project", "kind", "version"]).select("project", "kind", "task_id", "version")


@query(f"""select agent_id, count(*) as active, cast(sum(input_tokens + output_tokens + cache_tokens) as bigint) as tokens, cast(max(floor((epoch_us(timestamp '{AS_OF}') - epoch_us(started_at)) / 60000000)) as bigint) as longest_minutes
  from run join supplier on s_suppkey = agent_id where finished_at is null and started_at <= timestamp '{AS_OF}' group by 1""", ("run",))
def activity_snapshot(spark, sf):
    """What is running at one moment, by agent; minutes are those passed in full."""
    active = table(spark, sf, "run").filter(F.col("finished_at").isNull() & (F.col("started_at") <= _now()))
    agents = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_id"))
    sums = active.groupBy("agent_id").agg(F.count(F.lit(1)).alias("active"), F.sum(F.expr("input_tokens + output_tokens + cache_tokens")).alias("tokens"), F.max(X.whole_minutes(_now(), F.col("started_at"))).alias("longest_minutes"))
    return sums.join(agents, "agent_id")


@query(f"""select agent_id, count(*) as dead from run where finished_at is null and started_at < timestamp '{AS_OF}' - interval 300 second group by 1 having count(*) > 0""", ("run",))
def dead_runs_by_agent(spark, sf):
    """Runs whose sign of life is older than the limit."""
    return table(spark, sf, "run").filter(F.col("finished_at").isNull() & (F.col("started_at") < _now() - F.expr("interval 300 seconds"))).groupBy("agent_id").agg(F.count(F.lit(1)).alias("dead"))


@query("""select s_suppkey as agent_id, what, n from (select l_suppkey as k, 'runs' as what, count(*) as n from lineitem group by 1 union all select l_suppkey, 'returned', count(*) filter (where l_returnflag = 'R') from lineitem group by 1 union all
  select s_suppkey, 'home', count(n_nationkey) from supplier left join nation on n_nationkey = s_nationkey and n_regionkey = 1 group by 1) join supplier on s_suppkey = k where n > 0""")
def agent_reference_counts(spark, sf):
    """What refers to an agent, labelled; kinds without any are left out. One pass over runs gives two of them."""
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("agent_id")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    long = runs.unpivot("agent_id", ["runs", "returned"], "what", "n")
    agents = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_id"), "s_nationkey")
    home = agents.join(table(spark, sf, "nation").filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey")).select("agent_id", F.lit("home").alias("what"), F.lit(1).cast("long").alias("n"))
    return long.filter("n > 0").join(agents.select("agent_id"), "agent_id", "left_semi").select("agent_id", "what", "n").unionByName(home)


@query("""select type_key, status_key, string_agg(cast(agent_id as varchar), ',' order by position) filter (where place <= 10) as agents, count(*) as n, arg_min(mode, position) as mode
  from (select *, row_number() over (partition by type_key, status_key order by position) as place from assignment) group by 1, 2""", ("assignment",))
def assignment_matrix(spark, sf):
    """Who works where: how many agents, the first ten, and the mode, which the first in line sets for all."""
    staff = table(spark, sf, "assignment")
    first = R.first_per(staff, ["type_key", "status_key"], [F.col("position")], 10).groupBy("type_key", "status_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "agent_id"))), lambda x: x["agent_id"].cast("string")), ",").alias("agents"))
    return staff.groupBy("type_key", "status_key").agg(F.count(F.lit(1)).alias("n"), F.min_by("mode", "position").alias("mode")).join(first, ["type_key", "status_key"])


CLAIMS = "l_shipdate l_orderkey l_linenumber l_suppkey l_extendedprice l_discount l_tax".split()
CLAIMS_SQL = f"select l_partkey as task_id, l_suppkey as agent_id, l_orderkey as asked_by, row_number() over (partition by l_partkey order by {', '.join(CLAIMS)}) = 1 as won from lineitem"


def claims(spark, sf):
    return R.claims(table(spark, sf, "lineitem"), "l_partkey", [F.col(c) for c in CLAIMS]).select(F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("agent_id"), F.col("l_orderkey").alias("asked_by"), "won")


@query(CLAIMS_SQL)
def reservation_claims(spark, sf):
    """Claims on the same task: the first one wins."""
    return claims(spark, sf)


@query("select count(distinct l_partkey) as tasks, cast(0 as bigint) as taken_twice, cast(0 as bigint) as not_taken from lineitem")
def double_take_check(spark, sf):
    """The claims' invariant: of the tasks that anyone asked for none is reserved twice, and none is left."""
    wins = claims(spark, sf).groupBy("task_id").agg(F.count_if("won").alias("wins"))
    return wins.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("wins") > 1).alias("taken_twice"), F.count_if(F.col("wins") == 0).alias("not_taken"))
