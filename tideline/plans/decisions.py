"""Who may move a task where, and which tasks are launched: the rules in their order, over flows kept as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators.rules import REPORTS, decided
from ..sources.adapter import table
from .catalog import query

VIEWS = ("flow_version", "flow_status", "flow_transition", "project", "task", "card", "relation", "run", "item", "artifact", "assignment")
KINDS = ("developer", "reviewer", "tester", "psi")
CLOSED = ("done", "canceled")


def current(spark: SparkSession, sf: str, name: str = "flow_version") -> DataFrame:
    """Rows of a flow table that belong to their type's current version: the one that is current and published."""
    now = table(spark, sf, "flow_version").filter("is_current and is_published").select("version_id")
    return table(spark, sf, name).join(now, "version_id", "left_semi")


@query("select type_key, version_id, version, n_statuses from flow_version join (select version_id, count(*) as n_statuses from flow_status group by 1) using (version_id) where is_current and is_published", ("flow_version", "flow_status"))
def current_flow_versions(spark, sf):
    """The version by which a type's tasks live; a type whose current version is not published has none."""
    counts = table(spark, sf, "flow_status").groupBy("version_id").agg(F.count(F.lit(1)).alias("n_statuses"))
    return current(spark, sf).join(counts, "version_id").select("type_key", "version_id", "version", "n_statuses")


@query("""select v.version_id, string_agg(s.status_key, ',' order by s.position) as nodes, (select string_agg(current || '>' || target, ',' order by current, target) from flow_transition e where e.version_id = v.version_id) as edges
  from flow_version v join flow_status s using (version_id) group by v.version_id""", ("flow_version", "flow_status", "flow_transition"))
def flow_graphs(spark, sf):
    """Each version as one row: nodes by position, edges by source."""
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, value.alias("v")))), lambda x: x["v"]), ",")
    nodes = table(spark, sf, "flow_status").groupBy("version_id").agg(ordered(["position"], F.col("status_key")).alias("nodes"))
    edges = table(spark, sf, "flow_transition").groupBy("version_id").agg(ordered(["current", "target"], F.concat("current", F.lit(">"), "target")).alias("edges"))
    return nodes.join(edges, "version_id", "left")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per task with what the rules look at: each fact is an aggregate by task, and the checklists are one pass."""
    count = lambda kind, which: F.count_if((F.col("kind") == kind) & which)
    state = lambda k: F.struct(count(k, F.lit(True)).alias("total"), count(k, F.col("status").isin("todo", "in_progress")).alias("open"), count(k, F.col("status") == "failed").alias("failed")).alias(k)
    stamp = lambda k: F.max(F.when(F.col("kind") == k, F.col("ref"))).alias(f"{k}_ref")
    items = table(spark, sf, "item").groupBy("task_id").agg(*map(state, KINDS), stamp("psi"), stamp("developer"))
    still = table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("to_task"))
    held = table(spark, sf, "relation").filter("kind = 'blocked_by'").join(still, "to_task", "left_semi").select(F.col("from_task").alias("task_id")).distinct().withColumn("blocked", F.lit(True))
    reports = table(spark, sf, "artifact").groupBy("task_id").agg(F.collect_set("kind").alias("reports"))
    rows = table(spark, sf, "card").join(items, "task_id", "left").join(held, "task_id", "left").join(reports, "task_id", "left")
    # a story without a plan counts as stale; another task is stale only if its developer's checklist has an older stamp
    stale = F.when(F.col("type_key") == "story", F.coalesce(F.col("psi_ref"), F.lit(-1)) < F.col("ref_version")).otherwise(F.coalesce(F.col("developer_ref") < F.col("ref_version"), F.lit(False)))
    return rows.withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("plan_stale", stale).withColumn("psi_failed", F.coalesce("psi.failed", F.lit(0)))


def decisions(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """asked (of facts, with target and subject) with code: what each subject is answered."""
    edges = current(spark, sf, "flow_transition").select("type_key", "current", "target", "runner", "cond_links", "cond_checklist", "cond_artifact")
    status = current(spark, sf, "flow_status")
    source = status.select("type_key", F.col("status_key").alias("current"), F.col("is_terminal").alias("current_terminal"), F.col("gate").alias("source_gate"))
    target = status.select("type_key", F.col("status_key").alias("target"), F.lit(True).alias("target_known"), F.col("gate").alias("target_gate"))
    rights = table(spark, sf, "assignment").select("type_key", F.col("status_key").alias("current"), "agent_id", F.lit(True).alias("assigned")).distinct()
    rows = asked.withColumnRenamed("status_key", "current").join(edges, ["type_key", "current", "target"], "left").join(source, ["type_key", "current"], "left").join(target, ["type_key", "target"], "left").join(rights, ["type_key", "current", "agent_id"], "left")
    of = lambda gate: F.coalesce(*(F.when(F.col(gate) == k, F.col(k)) for k in KINDS))
    report = reduce(lambda w, x: w.when(F.col("current") == x[0], x[1]), REPORTS.items(), F.when(F.lit(False), ""))
    rows = rows.fillna(False, ["target_known", "assigned"]).withColumn("source_state", of("source_gate")).withColumn("target_state", of("target_gate")).withColumn("has_report", F.coalesce(F.array_contains("reports", report), F.lit(False)))
    return rows.withColumn("code", decided(rows))


#: The same facts in SQL. A rule that denies is a row with its place in the order, and the answer is the first of them.
FACTS_SQL = """+ state as (select task_id, kind, count(*) as total, count(*) filter (where status in ('todo', 'in_progress')) as still, count(*) filter (where status = 'failed') as failed, max(ref) as ref from item group by 1, 2),
  held as (select distinct from_task as task_id from relation join task b on b.task_id = to_task where kind = 'blocked_by' and b.status_key not in ('done', 'canceled')), now as (select version_id from flow_version where is_current and is_published),
  stage(key, n) as (values ('todo', 2), ('in_progress', 3), ('in_review', 4), ('in_testing', 5), ('done', 6)), report(key, kind) as (values ('in_progress', 'dev_report'), ('in_review', 'review_report'), ('in_testing', 'qa_report'))"""

DENIALS_SQL = """, edge as (select a.*, e.runner, e.cond_links, e.cond_checklist, e.cond_artifact from asked a left join (select * from flow_transition where version_id in (from now)) e on e.type_key = a.type_key and e.current = a.status_key and e.target = a.target),
  node as (select * from flow_status where version_id in (from now)),
  gate as (select edge.*, src.gate as g1, dst.gate as g2, coalesce(b.n, 0) > coalesce(a.n, 0) as forward, s1.total as t1, s1.still as o1, s1.failed as f1, s2.total as t2, src.is_terminal as over from edge left join node src on src.type_key = edge.type_key and src.status_key = edge.status_key
    left join node dst on dst.type_key = edge.type_key and dst.status_key = edge.target left join stage a on a.key = edge.status_key left join stage b on b.key = edge.target
    left join state s1 on s1.task_id = edge.task_id and s1.kind = src.gate left join state s2 on s2.task_id = edge.task_id and s2.kind = dst.gate),
  held_checks as (select * from gate where cond_checklist and target not in ('blocked', 'canceled')),
  denied as (
    select task_id, target, 1 as n, 'no_status' as code from edge where runner is null and (type_key, target) not in (select type_key, status_key from node)
    union all select task_id, target, 2, 'no_edge' from edge where runner is null
    union all select task_id, target, 3, 'runner_auto' from edge where subject = 'auto' and runner in ('agent', 'human')
    union all select task_id, target, 4, 'agent_not_assigned' from edge where subject = 'agent' and not exists (select 1 from assignment x where x.agent_id = edge.agent_id and x.type_key = edge.type_key and x.status_key = edge.status_key)
    union all select task_id, target, 5, 'runner_agent' from edge where subject = 'agent' and runner in ('auto', 'human')
    union all select task_id, target, 6, 'agent_cancel' from edge where subject = 'agent' and target = 'canceled'
    union all select task_id, target, 7, 'agent_terminal' from gate where subject = 'agent' and over
    union all select task_id, target, 8, 'links_blocked' from edge where cond_links and target in ('in_progress', 'in_review', 'in_testing') and task_id in (from held)
    union all select e.task_id, target, 9, 'plan_stale' from edge e left join state p on p.task_id = e.task_id and p.kind = case when type_key = 'story' then 'psi' else 'developer' end
      where target = 'done' and (p.ref < ref_version or p.ref is null and type_key = 'story')
    union all select e.task_id, target, 10, 'psi_failed' from edge e join state p on p.task_id = e.task_id and p.kind = 'psi' where target = 'done' and p.failed > 0
    union all select task_id, target, 11, 'checklist_not_created' from held_checks where forward and g1 is not null and t1 is null
    union all select task_id, target, 12, 'checklist_not_closed' from held_checks where forward and g1 is not null and o1 > 0
    union all select task_id, target, 13, 'checklist_failed' from held_checks where forward and g1 is not null and f1 > 0
    union all select task_id, target, 14, 'checklist_not_created' from held_checks where runner <> 'auto' and target = 'in_progress' and g2 is not null and t2 is null
    union all select task_id, target, 15, 'checklist_not_created' from held_checks where runner <> 'auto' and target = 'in_review' and forward and g2 is not null and t2 is null
    union all select e.task_id, target, 16, 'artifact_missing' from edge e join report r on r.key = e.status_key where cond_artifact and not exists (select 1 from artifact x where x.task_id = e.task_id and x.kind = r.kind)
  ), answer as (select task_id, target, arg_min(code, n) as code from denied group by 1, 2)"""

SUBJECT = "case weight % 3 when 0 then 'agent' when 1 then 'auto' else 'human' end"
AGENT = "case when t.task_id % 3 > 0 then (select min(agent_id) from assignment x where x.type_key = t.type_key and x.status_key = t.status_key) else -1 end"
TARGET = "case (weight div 3) % 8 when 0 then 'todo' when 1 then 'in_progress' when 2 then 'in_review' when 3 then 'in_testing' when 4 then 'blocked' when 5 then 'done' when 6 then 'canceled' else 'archive' end"


def _asked(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """rows with who asks: two thirds of the agents are those that are assigned to the task's type and status."""
    first = table(spark, sf, "assignment").groupBy("type_key", "status_key").agg(F.min("agent_id").alias("agent_id"))
    return rows.withColumn("subject", F.expr(SUBJECT)).join(first, ["type_key", "status_key"], "left").withColumn("agent_id", F.when(F.col("task_id") % 3 > 0, F.col("agent_id")).otherwise(F.lit(-1)))


@query(f"""{FACTS_SQL}, asked as (select t.*, e.target, {SUBJECT} as subject, {AGENT} as agent_id from card t join flow_transition e on e.type_key = t.type_key and e.current = t.status_key where e.version_id in (from now)) {DENIALS_SQL}
  select a.task_id, a.status_key as current, a.target, a.subject, coalesce(answer.code, 'ok') as code from asked a left join answer using (task_id, target)""", VIEWS)
def edge_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge out of every task's status in its type's current flow, with the first rule that denies it, or ok."""
    edges = current(spark, sf, "flow_transition").select("type_key", F.col("current").alias("status_key"), "target")
    asked = _asked(spark, sf, facts(spark, sf).join(edges, ["type_key", "status_key"]))
    return decisions(spark, sf, asked).select("task_id", "current", "target", "subject", "code")


@query(f"""{FACTS_SQL}, asked as (select t.*, {TARGET.replace("div", "//")} as target, {SUBJECT} as subject, {AGENT} as agent_id from card t) {DENIALS_SQL}
  select a.task_id, a.status_key as current, a.target, a.subject, coalesce(answer.code, 'ok') as code from asked a left join answer using (task_id, target)""", VIEWS)
def requested_moves(spark, sf):
    """One requested move a task, whether its flow has it or not: unknown targets and missing edges are answers too."""
    asked = _asked(spark, sf, facts(spark, sf).withColumn("target", F.expr(TARGET)))
    return decisions(spark, sf, asked).select("task_id", "current", "target", "subject", "code")


@query(f"""{FACTS_SQL}, ends as (select t.task_id, t.status_key as ended from card t where t.status_key in ('done', 'canceled')),
  near as (select distinct ended, p.* from ends join (select from_task, to_task from relation union select to_task, from_task from relation) r on r.from_task = ends.task_id join card p on p.task_id = r.to_task where p.type_key <> 'story' and p.status_key <> ended),
  asked as (select distinct near.* exclude (ended), ended as target, 'auto' as subject, 0 as agent_id from near) {DENIALS_SQL}
  select a.task_id, a.target, coalesce(answer.code, 'ok') as code from asked a left join answer using (task_id, target)""", VIEWS)
def cascade_decisions(spark, sf):
    """Whether the end of a task may end its neighbours too: each neighbour once a target, asked for by the system itself."""
    edges = table(spark, sf, "relation").select(F.col("from_task").alias("a"), F.col("to_task").alias("task_id"))
    both = edges.unionByName(edges.select(F.col("task_id").alias("a"), F.col("a").alias("task_id")))
    ended = table(spark, sf, "task").filter(F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("a"), F.col("status_key").alias("target"))
    reached = both.join(ended, "a").select("task_id", "target").distinct()
    asked = facts(spark, sf).join(reached, "task_id").filter((F.col("type_key") != "story") & (F.col("status_key") != F.col("target"))).withColumn("subject", F.lit("auto")).withColumn("agent_id", F.lit(0).cast("long"))
    return decisions(spark, sf, asked).select("task_id", "target", "code")


AS_OF = "1999-06-01 00:00:00"
# Minutes of the pauses after a run; runs and attempts of a task, at most; runs at a time.
PAUSES, MAX_RUNS, MAX_ATTEMPTS, SLOTS = (1, 5, 15), 6, 3, 25
LATEST = "finished_at desc, attempt_no desc, session_id desc, input_tokens desc, output_tokens desc"
#: Parts of the tasks of a type and status, each of which meets all agents of it in a task of its own.
SPREAD = 64
SCHEDULER_VIEWS = ("flow_version", "flow_status", "project", "task", "card", "relation", "run", "item", "assignment")


#: The CTEs of the scheduler's facts, and its answer for each pair.
SCHEDULER_FACTS = f"""staff as (select *, row_number() over (partition by type_key, status_key order by position) as place, first_value(mode) over (partition by type_key, status_key order by position) as leading from assignment),
  active as (select distinct task_id, agent_id from run where finished_at is null and started_at > timestamp '1999-01-01'),
  last as (select task_id, agent_id, finished_at, attempt_no, outcome from run where finished_at is not null qualify row_number() over (partition by task_id, agent_id order by {LATEST}) = 1),
  plan as (select task_id, max(ref) as stamp from item where kind = 'psi' group by 1), stand as (select type_key, status_key from flow_status join flow_version using (version_id, type_key) where is_current and is_published and list_contains(string_split(behaviors, ','), 'verify_stand')),
  spent as (select r.task_id, count(*) as n from run r join task t on t.task_id = r.task_id where (reason_code is null or reason_code not in ('soft_turns', 'stale_status')) and (runs_reset_at is null or started_at > runs_reset_at) group by 1),
  flop as (select task_id, reason_code from run where outcome = 'failed' qualify row_number() over (partition by task_id order by started_at desc, attempt_no desc, session_id desc, input_tokens desc, output_tokens desc) = 1),
  held as (select distinct from_task as task_id from relation join task b on b.task_id = to_task where kind = 'blocked_by' and b.status_key not in ('done', 'canceled')),
  pair as (select t.*, s.agent_id, s.connection, case when s.leading = 'parallel' then 'parallel' else 'replacement' end as run_mode, s.place from card t left join staff s on s.type_key = t.type_key and s.status_key = t.status_key and (s.place = 1 or s.leading = 'parallel')
    where t.status_key not in ('pending', 'blocked', 'done', 'canceled') and not is_archived)"""
SCHEDULER_ANSWER = f"""select p.task_id, p.agent_id, run_mode, case when p.weight % 17 = 0 then 'reserved' when p.agent_id is null then 'not_assigned' when a.task_id is not null then 'running'
    when l.task_id is not null and finished_at + interval 1 minute * (case when outcome in ('interrupted', 'success') then 15 else [1, 5, 15][least(greatest(l.attempt_no, 1), 3)] end) > timestamp '{AS_OF}' and not (p.type_key = 'story' and ref_version > coalesce(stamp, 0)) then 'retry_pause'
    when p.connection = 3 then 'provider_paused' when st.type_key is not null and p.project_id % 3 = 0 then 'stand_down' when coalesce(n, 0) >= {MAX_RUNS} then 'run_limit'
    when retry_count >= {MAX_ATTEMPTS} and f.reason_code = 'provider_unreachable' then 'provider_unreachable' when retry_count >= {MAX_ATTEMPTS} then 'attempts_exhausted' when h.task_id is not null then 'hard_blocked' else 'launch' end as decision
  from pair p left join active a on a.task_id = p.task_id and a.agent_id = p.agent_id left join last l on l.task_id = p.task_id and l.agent_id = p.agent_id left join plan on plan.task_id = p.task_id left join stand st on st.type_key = p.type_key and st.status_key = p.status_key
    left join spent on spent.task_id = p.task_id left join flop f on f.task_id = p.task_id left join held h on h.task_id = p.task_id"""


@query(f"+ {SCHEDULER_FACTS} {SCHEDULER_ANSWER}", SCHEDULER_VIEWS)
def scheduler_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Why each pair of a candidate task and an agent is launched or not: the first rule in the scheduler's order.

    Assignment (all agents where the first is parallel, else the first one), a live run of the pair, the pause after its last run
    (not for a story whose plan is out of date), a paused provider, a stand that is down, then the task's run limit,
    its attempts (which a provider's failure spares), and open blockers. Rows are as many as there are pairs.
    """
    tasks = _candidates(spark, sf)[0].select("task_id", "type_key", "status_key", "reserved", "fresh", "rest", "live_agents", "waiting_agents", F.pmod(F.xxhash64("task_id"), F.lit(SPREAD)).cast("int").alias("part"))
    staff = _staff(spark, sf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).hint("merge")  # never sent whole to each executor
    pairs = tasks.join(staff, ["type_key", "status_key", "part"], "left")
    of = lambda agents: F.array_contains(agents, F.col("agent_id"))
    rules = [(F.col("reserved"), "reserved"), (F.col("agent_id").isNull(), "not_assigned"), (of("live_agents"), "running"), (of("waiting_agents") & ~F.col("fresh"), "retry_pause"), (F.col("paused"), "provider_paused")]
    decision = F.coalesce(*(F.when(c, F.lit(k)) for c, k in rules), "rest")
    return pairs.select("task_id", "agent_id", F.coalesce("run_mode", F.lit("replacement")).alias("run_mode"), decision.alias("decision"))


def _staff(spark: SparkSession, sf: str) -> DataFrame:
    """The agents of a type and status that may be launched: all where the first is parallel, else the first."""
    by_place = Window.partitionBy("type_key", "status_key").orderBy("position")
    staff = table(spark, sf, "assignment").withColumn("place", F.row_number().over(by_place)).withColumn("leading", F.first("mode").over(by_place)).filter("place = 1 or leading = 'parallel'")
    return staff.select("type_key", "status_key", "agent_id", (F.col("connection") == 3).alias("paused"), F.when(F.col("leading") == "parallel", "parallel").otherwise("replacement").alias("run_mode"))


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tasks that may be launched, decided once each, and the pairs of a task and an agent that have an answer of their own.

    An agent's answer differs from its task's where the pair has a live run or is in the pause after its last one, so there are
    no more such pairs than runs; of the other agents only the number counts, by whether their provider is paused.
    """
    staff = _staff(spark, sf)
    teams = staff.groupBy("type_key", "status_key").agg(F.first("run_mode").alias("run_mode"), F.count(F.lit(1)).alias("n_agents"), F.count_if("paused").alias("all_paused"))
    candidates = table(spark, sf, "card").filter(~F.col("status_key").isin("pending", "blocked", *CLOSED) & ~F.col("is_archived"))
    runs = table(spark, sf, "run").join(candidates.select("task_id", "type_key", "status_key", "runs_reset_at"), "task_id")
    newest = F.struct("finished_at", "attempt_no", "session_id", "input_tokens", "output_tokens")
    live = F.bool_or(F.col("finished_at").isNull() & (F.col("started_at") > F.lit("1999-01-01").cast("timestamp_ntz")))
    by_pair = runs.groupBy("task_id", "agent_id", "type_key", "status_key").agg(live.alias("live"), F.max(F.when(F.col("finished_at").isNotNull(), F.struct(newest.alias("k"), "finished_at", "attempt_no", "outcome"))).alias("last"))
    counts = (F.col("reason_code").isNull() | ~F.col("reason_code").isin("soft_turns", "stale_status")) & (F.col("runs_reset_at").isNull() | (F.col("started_at") > F.col("runs_reset_at")))
    failed = F.when(F.col("outcome") == "failed", F.struct("started_at", "attempt_no", "session_id", "input_tokens", "output_tokens"))
    by_task = runs.groupBy("task_id").agg(F.count_if(counts).alias("spent"), F.max_by("reason_code", failed).alias("last_reason"))
    plan = table(spark, sf, "item").filter("kind = 'psi'").groupBy("task_id").agg(F.max("ref").alias("stamp"))
    still = table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("to_task"))
    held = table(spark, sf, "relation").filter("kind = 'blocked_by'").join(still, "to_task", "left_semi").select(F.col("from_task").alias("task_id")).distinct().withColumn("held", F.lit(True))
    stand = current(spark, sf, "flow_status").filter(F.array_contains(F.split("behaviors", ","), "verify_stand")).select("type_key", "status_key", F.lit(True).alias("on_stand"))
    ladder = F.array(*map(F.lit, PAUSES))
    pause = F.when(F.col("last.outcome").isin("interrupted", "success"), PAUSES[-1]).otherwise(F.element_at(ladder, F.least(F.greatest("last.attempt_no", F.lit(1)), F.lit(len(PAUSES)))))
    over = F.unix_micros(F.col("last.finished_at").cast("timestamp")) + pause.cast("long") * 60_000_000 > F.unix_micros(F.lit(AS_OF).cast("timestamp_ntz").cast("timestamp"))
    own = by_pair.join(staff.select("type_key", "status_key", "agent_id", "paused"), ["type_key", "status_key", "agent_id"]).select("task_id", "agent_id", "paused", "live", F.coalesce(over, F.lit(False)).alias("over")).filter("live or over")
    tasks = candidates.join(teams, ["type_key", "status_key"], "left").join(by_task, "task_id", "left").join(plan, "task_id", "left").join(held, "task_id", "left").join(stand, ["type_key", "status_key"], "left")
    fresh = (F.col("type_key") == "story") & (F.col("ref_version") > F.coalesce("stamp", F.lit(0)))
    waits = F.col("over") & ~F.col("live")
    odd = own.groupBy("task_id").agg(*(F.count_if(c).alias(n) for n, c in (("running", F.col("live")), ("running_paused", F.col("live") & F.col("paused")), ("waiting", waits), ("waiting_paused", waits & F.col("paused")))), *(F.collect_set(F.when(c, F.col("agent_id"))).alias(n) for n, c in (("live_agents", F.col("live")), ("waiting_agents", waits))))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    unless_fresh = lambda c: F.when(fresh, 0).otherwise(n(c))
    rules = [
        (F.col("on_stand") & (F.col("project_id") % 3 == 0), "stand_down"),
        (F.col("spent") >= MAX_RUNS, "run_limit"),
        ((F.col("retry_count") >= MAX_ATTEMPTS) & (F.col("last_reason") == "provider_unreachable"), "provider_unreachable"),
        (F.col("retry_count") >= MAX_ATTEMPTS, "attempts_exhausted"),
        (F.col("held"), "hard_blocked"),
    ]
    tasks = tasks.join(odd, "task_id", "left").withColumns({
        "run_mode": F.coalesce("run_mode", F.lit("replacement")), "n_agents": n("n_agents"), "reserved": F.col("weight") % 17 == 0, "fresh": fresh, "n_running": n("running"), "n_pause": unless_fresh("waiting"), "n_paused": n("all_paused") - n("running_paused") - unless_fresh("waiting_paused"),
        "n_free": n("n_agents") - n("all_paused") - (n("running") - n("running_paused")) - (unless_fresh("waiting") - unless_fresh("waiting_paused")), "rest": F.coalesce(*(F.when(c, F.lit(k)) for c, k in rules), F.lit("launch")),
    })
    return tasks, own


@query(f"""+ staff as (select *, row_number() over (partition by type_key, status_key order by position) as place from assignment)
  select version_id, type_key, s.status_key, agent_id, not exists (select 1 from flow_transition e where e.version_id = s.version_id and e.current = s.status_key and e.runner in ('agent', 'auto_or_agent', 'auto')) as rejected
  from flow_status s join flow_version v using (version_id, type_key) join assignment a using (type_key, status_key) where v.is_current and is_published""", ("flow_version", "flow_status", "flow_transition", "assignment"))
def assigned_statuses(spark, sf):
    """The statuses that agents are assigned to in the current flows, and whether there is nothing for an agent to do there."""
    work = current(spark, sf, "flow_transition").filter(F.col("runner").isin("agent", "auto_or_agent", "auto")).select("version_id", F.col("current").alias("status_key"), F.lit(True).alias("works")).distinct()
    rows = current(spark, sf, "flow_status").select("version_id", "type_key", "status_key").join(table(spark, sf, "assignment").select("type_key", "status_key", "agent_id"), ["type_key", "status_key"])
    return rows.join(work, ["version_id", "status_key"], "left").select("version_id", "type_key", "status_key", "agent_id", F.col("works").isNull().alias("rejected"))


@query(f"select version_id, status_key, cast(row_number() over (partition by version_id order by position) - 1 as bigint) as ordinal from flow_status union all select version_id, 'archive', 1000000 from flow_version", ("flow_version", "flow_status"))
def stage_positions(spark, sf):
    """A status's place in its version; one that the version does not know comes after all others."""
    known = table(spark, sf, "flow_status").select("version_id", "status_key", (F.row_number().over(Window.partitionBy("version_id").orderBy("position")) - 1).cast("long").alias("ordinal"))
    asked = table(spark, sf, "flow_status").select("version_id", "status_key").unionByName(table(spark, sf, "flow_version").select("version_id", F.lit("archive").alias("status_key")))
    return asked.join(known, ["version_id", "status_key"], "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(1_000_000).cast("long")))


@query("select version_id, status_key, list_contains(string_split(behaviors, ','), 'verify_stand') as on_stand, list_contains(string_split(behaviors, ','), 'work') as works from flow_status", ("flow_version", "flow_status"))
def status_behaviours(spark, sf):
    """Behaviours are flags in data: a status has those that its list contains."""
    has = lambda name: F.array_contains(F.split("behaviors", ","), name)
    return table(spark, sf, "flow_status").select("version_id", "status_key", has("verify_stand").alias("on_stand"), has("work").alias("works"))


@query(f"""{FACTS_SQL}, asked as (select t.*, e.target, {SUBJECT} as subject, {AGENT} as agent_id from card t join flow_transition e on e.type_key = t.type_key and e.current = t.status_key where e.version_id in (from now)) {DENIALS_SQL}
  select a.task_id, coalesce(string_agg(a.target, ',' order by a.target) filter (where answer.code is null), '') as allowed, coalesce(string_agg(a.target || ':' || answer.code, ',' order by a.target) filter (where answer.code is not null), '') as denied
  from asked a left join answer using (task_id, target) group by 1""", VIEWS)
def card_targets(spark, sf):
    """A task's card: where it may go, and why it may not go elsewhere."""
    rows = edge_decisions(spark, sf)
    listed = lambda which, value: F.array_join(F.array_sort(F.collect_list(F.when(which, value))), ",")
    ok = F.col("code") == "ok"
    return rows.groupBy("task_id").agg(listed(ok, F.col("target")).alias("allowed"), listed(~ok, F.concat("target", F.lit(":"), "code")).alias("denied"))


RANK = "case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end"


@query(f"""+ {SCHEDULER_FACTS}, answer as ({SCHEDULER_ANSWER}), holds as (select r.to_task as task_id, count(*) as n from relation r join task t on t.task_id = r.from_task where kind = 'blocked_by' and t.status_key not in ('done', 'canceled') group by 1),
  waits as (select distinct r.from_task as task_id from relation r join task t on t.task_id = r.to_task where kind = 'do_after' and t.status_key not in ('done', 'canceled'))
  select a.task_id, agent_id, run_mode, coalesce(h.n, 0) as blocks, w.task_id is not null as waits from answer a join task t using (task_id) left join holds h using (task_id) left join waits w on w.task_id = a.task_id where decision = 'launch'
  order by {RANK}, -coalesce(h.n, 0), type_key <> 'bug', w.task_id is not null, created_at, code, agent_id limit {SLOTS}""", SCHEDULER_VIEWS)
def launched_pairs(spark, sf):
    """The free slots go to the first pairs that no rule skips."""
    return launched(spark, sf).select("task_id", "agent_id", "run_mode", "blocks", "waits")


def launched(spark: SparkSession, sf: str, slots: int = SLOTS) -> DataFrame:
    """The pairs that get the free slots, in launch order: urgency, what a task holds up, bugs, waiting tasks last, age.

    A task that is launched has a free agent, so the first slots of all pairs are among those of as many first tasks.
    """
    from .queue import after, blocks

    tasks, own = _candidates(spark, sf)
    ready = tasks.filter("not reserved and n_agents > 0 and n_free > 0 and rest = 'launch'").join(blocks(spark, sf).withColumnRenamed("n", "blocks"), "task_id", "left").join(after(spark, sf).withColumn("waits", F.lit(True)), "task_id", "left").fillna(0, ["blocks"]).fillna(False, ["waits"])
    order = [X.priority_rank(F.col("priority")), -F.col("blocks"), F.col("type_key") != "bug", F.col("waits"), F.col("created_at"), F.col("code")]
    first = R.top(ready, order, slots)
    pairs = _staff(spark, sf).filter("not paused").drop("run_mode").join(F.broadcast(first), ["type_key", "status_key"])
    busy = own.select("task_id", "agent_id", "live").withColumn("own", F.lit(True))
    free = pairs.join(busy, ["task_id", "agent_id"], "left").filter(F.col("own").isNull() | (~F.col("live") & F.col("fresh")))
    return R.top(free, [*order, F.col("agent_id")], slots)
