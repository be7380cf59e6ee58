"""State machines: mirroring, edge decisions, validation and reachability of flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import relational as R
from ..operators.rules import PREDICATES, mirrored
from ..sources.adapter import table
from .catalog import query

# The mirroring edges of a story's flow with their rules and conditions, in the order of the stages.
MIRROR = [
    ("todo", "in_progress", "M1", ("children_any_active",), 2), ("in_progress", "qa_ready", "M2", ("children_all_closed",), 3), ("in_progress", "blocked", "M5", ("children_all_blocked",), 9),
    ("qa_ready", "psi_review", "M3a", ("psi_plan_registered_current",), 4), ("psi_review", "in_testing", "M3b", ("psi_manager_approved",), 5), ("psi_review", "qa_ready", "M3c", ("psi_manager_rejected",), 3), ("psi_review", "in_progress", "M1", ("children_any_active",), 2),
    ("in_testing", "in_progress", "M1", ("children_any_active",), 2), ("blocked", "in_progress", "M1", ("children_any_active",), 2), ("blocked", "qa_ready", "M2", ("children_all_closed", "blocked_by_children"), 3),
]
STORY_SQL = "case c_custkey % 6 when 0 then 'todo' when 1 then 'in_progress' when 2 then 'qa_ready' when 3 then 'psi_review' when 4 then 'in_testing' else 'blocked' end"
FACTS_SQL = f"""select c_custkey as story_id, {STORY_SQL} as status_key, case when c_custkey % 4 = 0 then 'M5' end as blocked_rule, case when c_custkey % 5 > 0 then c_custkey % 3 end as plan_ref, 1 as ref_version,
  case c_custkey % 3 when 0 then 'approved' when 1 then 'rejected' end as manager_state, c_custkey % 2 = 0 as manager_current from {{customer}}"""


def _mirror_sql() -> str:
    conditions = {
        "children_any_active": "coalesce(any_active, false)", "children_all_closed": "coalesce(n > 0 and all_closed, false)", "children_all_blocked": "coalesce(n > 0 and all_blocked, false)", "blocked_by_children": "coalesce(blocked_rule = 'M5', false)",
        "psi_plan_registered_current": "coalesce(plan_ref >= ref_version, false)", "psi_manager_approved": "coalesce(manager_state = 'approved', false) and manager_current", "psi_manager_rejected": "coalesce(manager_state = 'rejected', false)",
    }
    cases = [(at, to, rule, " and ".join(conditions[w] for w in when)) for at, to, rule, when, _ in sorted(MIRROR, key=lambda e: e[4])]
    pick = lambda k: " ".join(f"when status_key = '{c[0]}' and {c[3]} then '{c[k]}'" for c in cases)
    return f"""+ facts as ({FACTS_SQL.format(customer="customer")}), kids as (select story_id, count(*) as n, bool_or(status_key in ('in_progress', 'in_review', 'in_testing')) as any_active, bool_and(status_key in ('done', 'canceled')) as all_closed, bool_and(status_key = 'blocked') as all_blocked from task group by 1)
  select story_id, status_key, case {pick(1)} end as target, case {pick(2)} end as rule from facts left join kids using (story_id)"""


@query(_mirror_sql(), ("task",))
def mirror_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Where each story's status follows its children: the first satisfied edge by stage, if any."""
    facts = spark.sql(FACTS_SQL, customer=table(spark, sf, "customer"))
    kids = table(spark, sf, "task").groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status_key").isin("in_progress", "in_review", "in_testing")).alias("any_active"), F.bool_and(F.col("status_key").isin("done", "canceled")).alias("all_closed"), F.bool_and(F.col("status_key") == "blocked").alias("all_blocked"))
    edges = spark.createDataFrame(MIRROR, "at string, target string, rule string, when array<string>, position int")
    return mirrored(facts.join(kids, "story_id", "left"), edges, ["story_id", "status_key"])


@query("""select o_orderkey as task_id, count(l_orderkey) as total, count(l_orderkey) filter (where l_linestatus = 'O') as n_open, count(l_orderkey) filter (where l_returnflag = 'R') as n_failed,
  case when count(l_orderkey) = 0 then 'not_created' when count(*) filter (where l_returnflag = 'R') > 0 then 'failed' when count(*) filter (where l_linestatus = 'O') > 0 then 'open' else 'closed' end as state
  from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def gate_checklist_state(spark, sf):
    """A checklist's state by task; tasks without items have one that is not created. Items are counted before the join."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_returnflag") == "R").alias("n_failed"))
    counts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id")).join(items, "task_id", "left").fillna(0, ["total", "n_open", "n_failed"])
    return counts.withColumn("state", F.expr("case when total = 0 then 'not_created' when n_failed > 0 then 'failed' when n_open > 0 then 'open' else 'closed' end"))


@query("select o_orderkey as task_id, o_orderkey % 9 as stamp, case when o_orderkey % 9 = 0 and type_key = 'story' then 'missing' when o_orderkey % 9 > 0 and o_orderkey % 9 < ref_version then 'stale' else 'fresh' end as plan from orders join task on task_id = o_orderkey", ("task",))
def plan_staleness(spark, sf):
    """A story without a stamp has no plan and counts as stale; other tasks without one do not."""
    stamp = F.nullif(F.col("stamp"), F.lit(0))
    rows = table(spark, sf, "task").withColumn("stamp", F.col("task_id") % 9)
    return rows.select("task_id", "stamp", F.when(stamp.isNull() & (F.col("type_key") == "story"), "missing").when(stamp < F.col("ref_version"), "stale").otherwise("fresh").alias("plan"))


def _ways(spark, sf) -> DataFrame:
    """Which statuses of a version lead to which, directly or not."""
    edges = table(spark, sf, "flow_transition").select(F.struct("version_id", F.col("current").alias("status_key")).alias("a"), F.struct("version_id", F.col("target").alias("status_key")).alias("b"))
    return graphs.reachable(edges)[0].select(F.col("a.version_id").alias("version_id"), F.col("a.status_key").alias("a"), F.col("b.status_key").alias("b"))


WAYS_SQL = "+ ways(version_id, a, b) as (select version_id, current, target from flow_transition union select w.version_id, w.a, t.target from ways w join flow_transition t on t.version_id = w.version_id and t.current = w.b), s as (from flow_status)"


@query(f"{WAYS_SQL} select version_id, status_key as key, coalesce(is_entry, false) or exists (select 1 from ways w join s e on e.version_id = w.version_id and e.status_key = w.a and e.is_entry where w.version_id = s.version_id and w.b = s.status_key) as reachable from s", ("flow_version", "flow_status", "flow_transition"))
def flow_reachability(spark, sf):
    """Statuses of every version that can be reached from its entry."""
    statuses = table(spark, sf, "flow_status").select("version_id", F.col("status_key").alias("key"), F.coalesce("is_entry", F.lit(False)).alias("is_entry"))
    begins = statuses.filter("is_entry").select("version_id", F.col("key").alias("a"))
    seen = _ways(spark, sf).join(begins, ["version_id", "a"]).select("version_id", F.col("b").alias("key"), F.lit(True).alias("seen")).distinct()
    return statuses.join(seen, ["version_id", "key"], "left").select("version_id", "key", (F.col("is_entry") | F.coalesce("seen", F.lit(False))).alias("reachable"))


@query(f"""{WAYS_SQL} select version_id, status_key as key, 'no_way_to_end' as problem from s where is_terminal is not true and not exists (select 1 from ways w join s e on e.version_id = w.version_id and e.status_key = w.b and e.is_terminal where w.version_id = s.version_id and w.a = s.status_key)
  union all select version_id, status_key, 'dead_end' from s where is_terminal is not true and (version_id, status_key) not in (select version_id, current from flow_transition) union all select version_id, status_key, 'leaves_terminal' from s where is_terminal and (version_id, status_key) in (select version_id, current from flow_transition)""", ("flow_version", "flow_status", "flow_transition"))
def flow_validation(spark, sf):
    """What is wrong with the statuses of every version, one row a problem."""
    statuses = table(spark, sf, "flow_status").select("version_id", F.col("status_key").alias("key"), F.coalesce("is_terminal", F.lit(False)).alias("over"))
    ends = statuses.filter("over").select("version_id", F.col("key").alias("b"))
    leads = _ways(spark, sf).join(ends, ["version_id", "b"]).select("version_id", F.col("a").alias("key")).distinct()
    out = table(spark, sf, "flow_transition").select("version_id", F.col("current").alias("key")).distinct()
    found = {"no_way_to_end": statuses.filter("not over").join(leads, ["version_id", "key"], "left_anti"), "dead_end": statuses.filter("not over").join(out, ["version_id", "key"], "left_anti"), "leaves_terminal": statuses.filter("over").join(out, ["version_id", "key"], "left_semi")}
    return reduce(DataFrame.unionByName, (d.select("version_id", "key", F.lit(k).alias("problem")) for k, d in found.items()))


@query("select type_key, status_key, count(*) as in_flight from task where status_key not in (select unnest(['todo', 'in_progress', 'in_testing', 'blocked', 'done', 'canceled'])) group by 1, 2", ("task",))
def flow_publish_occupancy(spark, sf):
    """Statuses that a new version lacks while tasks are in them: they need a mapping."""
    new = spark.createDataFrame([(x,) for x in ("todo", "in_progress", "in_testing", "blocked", "done", "canceled")], "status_key string")
    return table(spark, sf, "task").join(F.broadcast(new), "status_key", "left_anti").groupBy("type_key", "status_key").agg(F.count(F.lit(1)).alias("in_flight"))


@query("select event_id, event_type, prior from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as prior from events) where prior is not null and (prior, event_type) not in (values ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('signup', 'view'), ('purchase', 'view'))")
def off_graph_transitions(spark, sf):
    """Steps in the log for which the graph has no edge."""
    edges = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"), ("purchase", "view")], "prior string, event_type string")
    steps = table(spark, sf, "events").withColumn("prior", F.lag("event_type").over(R.Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("prior is not null")
    return steps.join(F.broadcast(edges), ["prior", "event_type"], "left_anti").select("event_id", "event_type", "prior")


assert {w for *_, when, _ in MIRROR for w in when} <= set(PREDICATES)
