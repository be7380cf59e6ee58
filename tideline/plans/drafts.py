"""Drafts of flows: checks, copies, imports from text, and publishing with tasks under way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows
from ..operators.rules import PREDICATES
from ..sources.adapter import table
from .catalog import query

#: Versions as drafts, some of them with something wrong; both engines take the same SQL.
STATUSES = """
select version_id as draft, case when version_id = 'bug-1' and status_key = 'in_review' then 'In Review' else status_key end as key, is_entry or (version_id = 'bug-2' and status_key = 'in_progress') as is_entry,
  is_terminal and version_id <> 'qa_task-1' as is_terminal, status_key = 'blocked' as is_blocking, case when status_key = 'canceled' and version = 4 then '' else status_key end as alias
from {flow_status} where not (version_id = 'analyse_task-3' and status_key = 'canceled')
union all select 'story-1', 'island', false, false, false, 'island' union all select 'story-2', 'todo', false, false, false, 'todo'
"""
EDGES = """
select version_id as draft, case when version_id = 'bug-1' and current = 'in_review' then 'In Review' else current end as a, case when version_id = 'bug-1' and target = 'in_review' then 'In Review' when version_id = 'qa_task-2' and target = 'blocked' then 'archive' else target end as b, runner,
  case when runner = 'auto' and target = 'done' then case when version_id = 'bug-3' then array['children_all_closed'] end when version_id = 'bug-4' and runner = 'auto' then array['children_any_active', 'moon_is_full'] when version_id = 'qa_task-3' and target = 'in_review' then array['children_any_active'] end as "when"
from {flow_transition} where (current <> 'done' or version_id = 'common_task-1') and not (version_id = 'analyse_task-1' and current = 'blocked') and not (version_id = 'analyse_task-3' and target = 'canceled') and not (version_id = 'story-3' and target = 'in_progress')
union all select 'story-1', 'island', 'done', 'human', null
"""


def _spark(sql: str) -> str:
    return sql.replace("array['children_all_closed']", "array('children_all_closed')").replace("array['children_any_active', 'moon_is_full']", "array('children_any_active', 'moon_is_full')").replace("array['children_any_active']", "array('children_any_active')").replace('"when"', "`when`")


def drafts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spark.sql(_spark(STATUSES), flow_status=table(spark, sf, "flow_status")), spark.sql(_spark(EDGES), flow_transition=table(spark, sf, "flow_transition"))


BEGIN = f"+ s as ({STATUSES.format(flow_status='flow_status')}), e as ({EDGES.format(flow_transition='flow_transition')})"
PROBLEMS = f"""{BEGIN}, form as (
    select draft, 'error' as level, 'duplicate_key' as problem, '' as subject from s group by draft having count(*) > count(distinct key)
    union all select draft, 'error', 'bad_key', key from s where not regexp_full_match(key, '[a-z0-9_]+') union all select draft, 'error', 'entry_count', cast(count(*) filter (where is_entry) as varchar) from s group by draft having count(*) filter (where is_entry) <> 1
    union all select draft, 'error', 'no_terminal', '' from s group by draft having not bool_or(coalesce(is_terminal, false)) union all select distinct e.draft, 'error', 'leaves_terminal', a from e join s on s.draft = e.draft and s.key = a where is_terminal
    union all select draft, 'error', 'unknown_source', a || '>' || b from e where (draft, a) not in (select draft, key from s) union all select draft, 'error', 'unknown_target', a || '>' || b from e where (draft, b) not in (select draft, key from s)),
  ns as (select * from s where draft not in (select draft from form)), ne as (select * from e where draft not in (select draft from form)),
  fore(draft, key) as (select draft, key from ns where is_entry union select ne.draft, b from fore join ne on ne.draft = fore.draft and a = key), back(draft, key) as (select draft, key from ns where is_terminal union select ne.draft, a from back join ne on ne.draft = back.draft and b = key),
  found as (select * from form union all select draft, 'error', 'dead_end', key from ns where is_terminal is not true and (draft, key) not in (select draft, a from ne) union all select draft, 'warning', 'auto_without_conditions', a || '>' || b from ne where runner = 'auto' and coalesce(len("when"), 0) = 0
    union all select distinct ne.draft, 'error', 'gated_escape', a || '>' || b from ne join ns on ns.draft = ne.draft and ns.key = b where len("when") > 0 and (is_terminal or is_blocking) union all select draft, 'error', 'unknown_predicate', a || '>' || b || ' moon_is_full' from ne where list_contains("when", 'moon_is_full')
    union all select draft, 'error', 'unreachable', key from ns where (draft, key) not in (from fore) union all select draft, 'error', 'no_way_to_end', key from ns where (draft, key) not in (from back)
    union all select draft, 'warning', 'no_escapes', '' from ns group by draft having not (bool_or(key = 'canceled') and bool_or(key = 'blocked')) union all select draft, 'warning', 'no_column', key from ns where alias = '')"""
VIEWS = ("flow_version", "flow_status", "flow_transition")


def found(spark: SparkSession, sf: str) -> DataFrame:
    statuses, edges = drafts(spark, sf)
    return flows.problems(statuses, edges, tuple(PREDICATES), 8)


@query(f"{PROBLEMS} select * from found", VIEWS)
def flow_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each draft: errors of form first, and of drafts without any the graph."""
    return found(spark, sf)


@query(f"{PROBLEMS} select d.draft, count(problem) filter (where level = 'error') = 0 as publishable, count(problem) filter (where level = 'warning') as warnings from (select distinct draft from s) d left join found using (draft) group by 1", VIEWS)
def publishable_drafts(spark, sf):
    statuses, _ = drafts(spark, sf)
    counts = found(spark, sf).groupBy("draft").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return statuses.select("draft").distinct().join(counts, "draft", "left").select("draft", (F.coalesce("errors", F.lit(0)) == 0).alias("publishable"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


@query("select version_id, count(*) as statuses, cast(0 as bigint) as lost from flow_status group by 1", VIEWS)
def draft_copies(spark, sf):
    """A draft begins as a copy of its version: statuses with all their columns, none of them lost or changed."""
    own = table(spark, sf, "flow_status")
    copy = own.withColumn("version_id", F.concat("version_id", F.lit("-draft")))
    back = copy.withColumn("version_id", F.expr("substring(version_id, 1, length(version_id) - 6)"))
    lost = own.exceptAll(back).groupBy("version_id").agg(F.count(F.lit(1)).alias("lost"))
    return copy.groupBy(F.expr("substring(version_id, 1, length(version_id) - 6)").alias("version_id")).agg(F.count(F.lit(1)).alias("statuses")).join(lost, "version_id", "left").fillna(0, ["lost"])


@query("select version_id, count(*) as nodes, count(*) filter (where is_entry) as entries, (select count(*) from flow_transition t where t.version_id = s.version_id) as edges from flow_status s group by 1", VIEWS)
def imported_flows(spark, sf):
    """Flows exported as JSON texts and read again with a schema: what is not in it is not imported."""
    nodes = table(spark, sf, "flow_status").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("position", "status_key", "is_entry", "is_terminal"))).alias("statuses"))
    edges = table(spark, sf, "flow_transition").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("current", "target", "runner"))).alias("transitions"))
    text = nodes.join(edges, "version_id").select("version_id", F.to_json(F.struct("statuses", "transitions", F.lit("x").alias("comment"))).alias("text"))
    read = text.select("version_id", F.from_json("text", "statuses array<struct<status_key:string,is_entry:boolean>>, transitions array<struct<current:string,target:string,runner:string>>").alias("f"))
    return read.select("version_id", F.size("f.statuses").cast("long").alias("nodes"), F.size(F.filter("f.statuses", lambda x: x["is_entry"])).cast("long").alias("entries"), F.size("f.transitions").cast("long").alias("edges"))


#: New versions lack a status of the current one; where its tasks go.
REMOVED = "in_testing"
MAPPING = [("story", "in_testing", "in_review"), ("qa_task", "in_testing", "archive"), ("bug", "in_review", "todo"), ("analyse_task", "in_testing", "done")]


@query(f"""+ prev as (select type_key, status_key from flow_status join flow_version using (version_id, type_key) where is_current and is_published), next as (select * from prev where status_key <> '{REMOVED}'),
  gone as (select * from prev except select * from next), map(type_key, status_key, target) as (values {", ".join(map(str, MAPPING))}), busy as (select type_key, status_key, count(*) as in_flight from task group by 1, 2)
  select g.type_key, g.status_key, coalesce(in_flight, 0) as in_flight, target, case when coalesce(in_flight, 0) = 0 then 'free' when target is null then 'unmapped' when not exists (select 1 from next n where n.type_key = g.type_key and n.status_key = target) then 'bad_target' else 'moves' end as outcome
  from gone g left join map using (type_key, status_key) left join busy using (type_key, status_key)""", ("flow_version", "flow_status", "task"))
def publish_mapping(spark, sf):
    """What becomes of tasks in statuses that a new version lacks: they move by the mapping, or the version is refused."""
    return _mapped(spark, sf).select("type_key", "status_key", "in_flight", "target", "outcome")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    from .decisions import current

    before = current(spark, sf, "flow_status").select("type_key", "status_key")
    after = before.filter(F.col("status_key") != REMOVED)
    gone = before.join(after, ["type_key", "status_key"], "left_anti")
    mapping = spark.createDataFrame(MAPPING, "type_key string, status_key string, target string")
    busy = table(spark, sf, "task").groupBy("type_key", "status_key").agg(F.count(F.lit(1)).alias("in_flight"))
    known = after.select("type_key", F.col("status_key").alias("target"), F.lit(True).alias("known"))
    rows = gone.join(mapping, ["type_key", "status_key"], "left").join(busy, ["type_key", "status_key"], "left").join(known, ["type_key", "target"], "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(0)))
    return rows.withColumn("outcome", F.when(F.col("in_flight") == 0, "free").when(F.col("target").isNull(), "unmapped").when(F.col("known").isNull(), "bad_target").otherwise("moves"))


@query(f"""+ prev as (select type_key, status_key from flow_status join flow_version using (version_id, type_key) where is_current and is_published), map(type_key, status_key, target) as (values {", ".join(map(str, MAPPING))})
  select t.task_id, case when t.status_key = '{REMOVED}' and m.target in (select status_key from prev p where p.type_key = t.type_key and p.status_key <> '{REMOVED}') then m.target else t.status_key end as status_key from task t left join map m on m.type_key = t.type_key and m.status_key = t.status_key""", ("flow_version", "flow_status", "task"))
def migrated_tasks(spark, sf):
    """Tasks under way after publishing: those that may move have moved, the others are where they were."""
    moves = _mapped(spark, sf).filter("outcome = 'moves'").select("type_key", "status_key", "target")
    return table(spark, sf, "task").join(moves, ["type_key", "status_key"], "left").select("task_id", F.coalesce("target", "status_key").alias("status_key"))
