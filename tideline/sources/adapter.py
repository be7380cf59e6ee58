"""Workflow tables seen through the input folder's tables.

project <- nation, story <- customer, task <- orders, run <- lineitem, relation <- an order and the customer's order
before it. The definitions are plain SQL that both engines take, so the comparison starts from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASK = """
select o_orderkey as task_id, concat('TK-', cast(o_orderkey as varchar(20))) as code, c_nationkey as project_id, o_custkey as story_id,
  case c_mktsegment when 'BUILDING' then 'story' when 'AUTOMOBILE' then 'bug' when 'MACHINERY' then 'qa_task' when 'HOUSEHOLD' then 'analyse_task' else 'common_task' end as type_key,
  case o_orderstatus when 'P' then 'blocked'
    when 'O' then case o_orderkey % 4 when 0 then 'todo' when 1 then 'in_progress' when 2 then 'in_review' else 'in_testing' end
    else case when o_orderkey % 7 = 0 then 'canceled' else 'done' end end as status_key,
  case substring(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else 'none' end as priority,
  o_orderdate as created_at, cast(o_orderkey % 5 as int) as retry_count, cast(o_orderkey % 3 + 1 as int) as ref_version,
  case when o_orderkey % 11 = 0 then cast(timestamp '1998-01-01 00:00:00' as timestamp) end as runs_reset_at
from {orders} join {customer} on o_custkey = c_custkey
"""

RUN = """
select l_orderkey as task_id, l_suppkey as agent_id, l_partkey as session_id, l_linenumber as attempt_no, l_shipdate as started_at,
  case when l_linestatus = 'F' then l_shipdate end as finished_at,
  case l_returnflag when 'A' then 'success' when 'N' then 'failed' else 'interrupted' end as outcome,
  case l_linenumber when 1 then 'soft_turns' when 2 then 'stale_status' when 3 then 'provider_unreachable' when 4 then 'turns_limit' when 5 then 'timeout_work' end as reason_code,
  cast(l_quantity as bigint) as input_tokens, cast(floor(l_extendedprice) as bigint) as output_tokens, cast(l_linenumber as bigint) as cache_tokens
from {lineitem}
"""

RELATION = """
select o_orderkey as from_task, prior as to_task, case when o_orderkey % 2 = 0 then 'blocked_by' else 'do_after' end as kind
from (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prior from {orders}) x
where prior is not null
"""

PROJECT = "select n_nationkey as project_id, concat('P', cast(n_nationkey as varchar(10))) as mnemonic, n_name as project, n_nationkey % 8 = 5 as is_archived from {nation}"

#: A task with its title, weight and project: orders and customers are joined once.
CARD = f"""
select t.*, mnemonic, project, is_archived from ({TASK.replace("from {orders}", ", concat(c_name, ' order ', cast(o_orderkey as varchar(20))) as title, cast(floor(o_totalprice) as bigint) as weight from {orders}")}) t join {{project}} p on p.project_id = t.project_id
"""

ITEM = """
select l_orderkey as task_id, case l_linenumber % 4 when 0 then 'developer' when 1 then 'reviewer' when 2 then 'tester' else 'psi' end as kind, l_linenumber as position, l_partkey % 4 as ref,
  case when l_returnflag = 'R' and l_linestatus = 'F' then 'failed' when l_linestatus = 'O' and l_quantity > 40 then case when l_returnflag = 'A' then 'todo' else 'in_progress' end when l_returnflag = 'A' then 'closed' else 'done' end as status,
  concat('item ', cast(l_partkey as varchar(20))) as text from {lineitem}
"""

ARTIFACT = "select l_orderkey as task_id, case l_linenumber % 3 when 0 then 'dev_report' when 1 then 'review_report' else 'qa_report' end as kind, l_suppkey as version from {lineitem} where l_discount < 0.04"

ASSIGNMENT = """
select case s_nationkey % 5 when 0 then 'story' when 1 then 'bug' when 2 then 'qa_task' when 3 then 'analyse_task' else 'common_task' end as type_key,
  case s_suppkey % 6 when 0 then 'todo' when 1 then 'in_progress' when 2 then 'in_review' when 3 then 'in_testing' when 4 then 'done' else 'in_progress' end as status_key, s_suppkey as agent_id, case when s_acctbal > 6000 then 'parallel' else 'exclusive' end as mode, s_suppkey as position, s_nationkey % 7 as connection
from {supplier} where s_acctbal > 500
"""

FLOW_VERSION = """
select concat(type_key, '-', cast(version as varchar(10))) as version_id, type_key, version, version <= 4 as is_published, version = case when type_key = 'common_task' then 5 else 3 + rank % 2 end as is_current
from (select n_regionkey as rank, case n_regionkey when 0 then 'story' when 1 then 'bug' when 2 then 'qa_task' when 3 then 'analyse_task' else 'common_task' end as type_key, cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as version from {nation}) x
"""

# Statuses of a task's flow (position, first version, entry, terminal, checklist of the gate, behaviours) and its edges.
FLOW_STATUS = """
select version_id, type_key, version, s.status_key, s.position, s.is_entry, case when s.status_key = 'canceled' and version = 4 then null else s.is_terminal end as is_terminal, s.gate, s.behaviors
from {flow_version} v join (values ('todo', 0, 1, true, false, 'developer', ''), ('in_progress', 1, 1, false, false, 'developer', 'work'), ('in_review', 2, 1, false, false, 'reviewer', 'work'), ('in_testing', 3, 2, false, false, 'tester', 'work,verify_stand'),
  ('blocked', 4, 1, false, false, null, ''), ('done', 5, 1, false, true, null, ''), ('canceled', 6, 1, false, true, null, '')) as s(status_key, position, since, is_entry, is_terminal, gate, behaviors) on s.since <= v.version
"""

FLOW_TRANSITION = """
select version_id, type_key, version, e.current, e.target, e.runner, e.cond_links, e.cond_checklist, e.cond_artifact
from {flow_version} v join (values ('todo', 'in_progress', 1, 'agent', true, true, false), ('in_progress', 'in_review', 1, 'agent', false, true, true), ('in_progress', 'todo', 1, 'agent', false, true, false), ('in_review', 'in_testing', 2, 'auto_or_agent', true, true, false),
  ('in_review', 'in_progress', 1, 'agent', true, true, false), ('in_review', 'done', 1, 'auto', true, true, true), ('in_testing', 'done', 2, 'auto_or_agent', false, true, true), ('in_testing', 'blocked', 2, 'human', false, false, false), ('blocked', 'todo', 1, 'auto_or_agent', false, true, false),
  ('blocked', 'in_progress', 1, 'agent', true, true, false), ('todo', 'canceled', 1, 'human', false, false, false), ('in_progress', 'canceled', 1, 'agent', false, true, false), ('done', 'todo', 1, 'agent', false, false, false), ('in_progress', 'blocked', 1, 'auto', false, true, false))
  as e(current, target, since, runner, cond_links, cond_checklist, cond_artifact) on e.since <= v.version
"""

#: What is told of a story, in parts by importance: (story_id, part, place, line).
BUNDLE_LINE = """
select c_custkey as story_id, 1 as part, cast(0 as bigint) as place, concat('# ', c_name) as line from {customer}
union all select story_id, 2, row_number() over (partition by story_id order by status_key), concat(status_key, ': ', cast(n as varchar(20))) from (select story_id, status_key, count(*) as n from {task} group by story_id, status_key) x
union all select story_id, 3, 0, concat('tokens: ', cast(sum(input_tokens + output_tokens + cache_tokens) as varchar(30))) from {run} r join {task} t on t.task_id = r.task_id group by story_id
union all select story_id, 4, task_id, concat('- ', code, ' ', status_key, ', ', priority) from {task} where status_key not in ('done', 'canceled', 'blocked')
union all select story_id, 5, task_id, concat('! ', code, ' is blocked') from {task} where status_key = 'blocked'
union all select story_id, 6, from_task, concat(code, ' ', kind, ' ', cast(to_task as varchar(20))) from {relation} join {task} on task_id = from_task
union all select story_id, 7, row_number() over (partition by story_id order by code, kind), concat(code, ' ', kind, ': ', cast(n_closed as varchar(10)), ' of ', cast(n as varchar(10)))
  from (select story_id, code, kind, count(*) as n, sum(case when status in ('done', 'closed') then 1 else 0 end) as n_closed from {item} i join {task} t on t.task_id = i.task_id group by story_id, code, kind) x
union all select story_id, 8, row_number() over (partition by story_id order by code, text), concat('failed in ', code, ': ', text) from (select distinct story_id, code, text from {item} i join {task} t on t.task_id = i.task_id where status = 'failed') x
union all select story_id, 9, row_number() over (partition by story_id order by code, kind), concat(code, ' ', kind, ' v', cast(version as varchar(20))) from (select story_id, code, kind, max(version) as version from {artifact} a join {task} t on t.task_id = a.task_id group by story_id, code, kind) x
union all select story_id, 10, row_number() over (partition by story_id order by code), concat(code, ' has ', cast(n as varchar(10)), ' live runs') from (select story_id, code, count(*) as n from {run} r join {task} t on t.task_id = r.task_id where finished_at is null group by story_id, code) x
union all select story_id, 11, row_number() over (partition by story_id order by reason_code), concat(reason_code, ': ', cast(n as varchar(10))) from (select story_id, coalesce(reason_code, 'unknown') as reason_code, count(*) as n from {run} r join {task} t on t.task_id = r.task_id where outcome = 'failed' group by story_id, coalesce(reason_code, 'unknown')) x
union all select story_id, 12, task_id, concat('ended: ', code, ' ', status_key) from {task} where status_key in ('done', 'canceled')
union all select story_id, 13, row_number() over (partition by story_id order by x.type_key, x.status_key), concat(x.type_key, ' in ', x.status_key, ': ', cast(n as varchar(10)), ' agents')
  from (select distinct story_id, type_key, status_key from {task}) x join (select type_key, status_key, count(*) as n from {assignment} group by type_key, status_key) a on a.type_key = x.type_key and a.status_key = x.status_key
union all select story_id, 14, row_number() over (partition by story_id order by current, target), concat(current, ' > ', target)
  from (select distinct story_id, current, target from {task} t join {flow_transition} e on e.type_key = t.type_key and e.current = t.status_key where e.version = 3) x
union all select c_custkey, 15, 0, concat('project ', mnemonic, ' ', project) from {customer} join {project} on project_id = c_nationkey
"""

#: Tables under each view, and the views' definitions.
VIEWS = {
    "task": (TASK, ("orders", "customer")), "run": (RUN, ("lineitem",)), "relation": (RELATION, ("orders",)), "project": (PROJECT, ("nation",)), "card": (CARD, ("orders", "customer", "project")), "item": (ITEM, ("lineitem",)),
    "artifact": (ARTIFACT, ("lineitem",)), "assignment": (ASSIGNMENT, ("supplier",)), "flow_version": (FLOW_VERSION, ("nation",)), "flow_status": (FLOW_STATUS, ("flow_version",)), "flow_transition": (FLOW_TRANSITION, ("flow_version",)),
    "bundle_line": (BUNDLE_LINE, ("customer", "task", "run", "relation", "item", "artifact", "assignment", "flow_transition", "project")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, or a workflow view over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, names = VIEWS[name]
    sql = sql.replace("cast(timestamp '1998-01-01 00:00:00' as timestamp)", "timestamp_ntz '1998-01-01 00:00:00'")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def sql_views(*names: str) -> str:
    """The views as the beginning of a SQL statement for the comparison."""
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n][0].format(**{x: x for x in VIEWS[n][1]})})" for n in names)
