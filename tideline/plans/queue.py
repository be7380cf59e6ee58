"""Task lists, boards and the order of the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.adapter import table
from .catalog import query

RANK_SQL = "case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end"
CLOSED = ("done", "canceled")


def _queue_order() -> list:
    """Urgency, bugs first, age; the id makes it total."""
    return [X.priority_rank(F.col("priority")), F.col("type_key") != "bug", F.col("created_at"), F.col("task_id")]




def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with their project's name and their runs' tokens: one aggregate over runs, joined once."""
    used = table(spark, sf, "run").groupBy("task_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_tokens")).alias("tokens"))
    project = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))
    return table(spark, sf, "task").join(project, "project_id").join(used, "task_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


@query(f"""select task_id, code, project, type_key, status_key, priority, created_at, cast(coalesce((select sum(input_tokens + output_tokens + cache_tokens) from run r where r.task_id = t.task_id), 0) as bigint) as tokens
  from task t join (select n_name as project, n_nationkey from nation) on n_nationkey = project_id where status_key in ('todo', 'in_progress', 'in_review')
  order by {RANK_SQL}, type_key <> 'bug', created_at, task_id limit 200""", ("task", "run"))
def queue_list(spark: SparkSession, sf: str) -> DataFrame:
    """The board's feed: a top-k page of cards with their tokens, in queue order. The page is cut before tokens are added up."""
    page = R.top(table(spark, sf, "task").filter(F.col("status_key").isin("todo", "in_progress", "in_review")), _queue_order(), 200)
    used = table(spark, sf, "run").join(page.select("task_id"), "task_id", "left_semi").groupBy("task_id").agg(F.sum(F.expr("input_tokens + output_tokens + cache_tokens")).alias("tokens"))
    project = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))
    return page.join(project, "project_id").join(used, "task_id", "left").select("task_id", "code", "project", "type_key", "status_key", "priority", "created_at", F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("select project_id, count(*) as total from task where status_key not in ('done', 'canceled') group by project_id", ("task",))
def queue_total(spark, sf):
    """Totals for pages, without sorting."""
    return table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))


FLOW = "(values ('story', 'done', false), ('story', 'canceled', true), ('bug', 'done', true), ('bug', 'canceled', true), ('qa_task', 'done', true), ('common_task', 'done', true), ('analyse_task', 'done', cast(null as boolean)))"


@query(f"select task_id, t.type_key, t.status_key from task t left join {FLOW} f(type_key, status_key, is_terminal) on f.type_key = t.type_key and f.status_key = t.status_key where is_terminal is not true", ("task",))
def queue_exclude_terminal(spark, sf):
    """Tasks that are not known to be in a terminal status of their type's flow: unknown counts as open."""
    flow = spark.sql(f"select * from {FLOW[1:-1]} as f(type_key, status_key, is_terminal)")
    return table(spark, sf, "task").join(F.broadcast(flow), ["type_key", "status_key"], "left").filter(~F.coalesce("is_terminal", F.lit(False))).select("task_id", "type_key", "status_key")


@query(f"select task_id, code from task order by {RANK_SQL}, type_key <> 'bug', created_at, task_id limit 50 offset 150", ("task",))
def queue_page_offset(spark, sf):
    return R.top(table(spark, sf, "task"), _queue_order(), 50, 150).select("task_id", "code")


@query("select task_id, status_key, priority from task where status_key not in ('done', 'canceled') order by priority, created_at, task_id limit 100", ("task",))
def queue_snapshot_by_text(spark, sf):
    """The snapshot's order is that of the priority's text, not of its rank."""
    return R.top(table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)), [F.col("priority"), F.col("created_at"), F.col("task_id")], 100).select("task_id", "status_key", "priority")


@query("select p_partkey, p_name from part where p_name ilike '%an%' or p_brand ilike 'brand#1%'")
def search_substring(spark, sf):
    return table(spark, sf, "part").filter(X.contains_or_begins(" an ", F.col("p_name"), F.lit("")) | X.contains_or_begins("brand#1", F.lit(""), F.col("p_brand"))).select("p_partkey", "p_name")


@query("select n_nationkey as project_id, count(task_id) as tasks, count(task_id) filter (where status_key not in ('done', 'canceled')) as open_tasks from nation left join task on project_id = n_nationkey group by 1", ("task",))
def open_count_by_project(spark, sf):
    """Projects without tasks stay, with zero. Tasks are counted before they meet the projects."""
    counts = table(spark, sf, "task").groupBy("project_id").agg(F.count("task_id").alias("tasks"), F.count_if(~F.col("status_key").isin(*CLOSED)).alias("open_tasks"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id")).join(counts, "project_id", "left").fillna(0, ["tasks", "open_tasks"])


@query("select type_key, status_key, count(*) as n from task group by 1, 2", ("task",))
def status_matrix(spark, sf):
    return table(spark, sf, "task").groupBy("type_key", "status_key").agg(F.count(F.lit(1)).alias("n"))


@query("select story_id, code, title_up, is_bug from (select story_id, code, upper(c_name) as title_up, type_key = 'bug' as is_bug from task join customer on c_custkey = story_id where upper(code) = upper('tk-7'))", ("task",))
def lookup_by_code(spark, sf):
    """A point look-up by a unique key, whatever its case."""
    one = table(spark, sf, "task").filter(F.upper("code") == "TK-7")
    return one.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("story_id")).select("story_id", "code", F.upper("c_name").alias("title_up"), (F.col("type_key") == "bug").alias("is_bug"))


@query("select cast(r.from_task as bigint) as task_id, r.to_task as blocker from relation r join task b on b.task_id = r.to_task where kind = 'blocked_by' and b.status_key not in ('done', 'canceled')", ("task", "relation"))
def blockers_open(spark, sf):
    still = table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("to_task"))
    return table(spark, sf, "relation").filter("kind = 'blocked_by'").join(still, "to_task").select(F.col("from_task").alias("task_id"), F.col("to_task").alias("blocker"))


@query("select r.to_task as task_id, count(*) as n from relation r join task t on t.task_id = r.from_task where kind = 'blocked_by' and t.status_key not in ('done', 'canceled') group by 1", ("task", "relation"))
def blocks_count(spark, sf):
    """How many open tasks each task blocks."""
    return blocks(spark, sf)


def blocks(spark, sf):
    still = table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("from_task"))
    return table(spark, sf, "relation").filter("kind = 'blocked_by'").join(still, "from_task").groupBy(F.col("to_task").alias("task_id")).agg(F.count(F.lit(1)).alias("n"))


def after(spark, sf):
    still = table(spark, sf, "task").filter(~F.col("status_key").isin(*CLOSED)).select(F.col("task_id").alias("to_task"))
    return table(spark, sf, "relation").filter("kind = 'do_after'").join(still, "to_task", "left_semi").select(F.col("from_task").alias("task_id")).distinct()


@query("select distinct r.from_task as task_id from relation r join task t on t.task_id = r.to_task where kind = 'do_after' and t.status_key not in ('done', 'canceled')", ("task", "relation"))
def do_after_open(spark, sf):
    return after(spark, sf)


@query(f"""+ blocks as (select r.to_task as task_id, count(*) as n from relation r join task t on t.task_id = r.from_task where kind = 'blocked_by' and t.status_key not in ('done', 'canceled') group by 1),
  waits as (select distinct r.from_task as task_id from relation r join task t on t.task_id = r.to_task where kind = 'do_after' and t.status_key not in ('done', 'canceled'))
  select t.task_id, coalesce(n, 0) as blocks, w.task_id is not null as waits from task t left join blocks b using (task_id) left join waits w on w.task_id = t.task_id
  where status_key in ('todo', 'in_progress') order by {RANK_SQL}, -coalesce(n, 0), type_key <> 'bug', w.task_id is not null, created_at, t.task_id limit 100""", ("task", "relation"))
def launch_queue(spark, sf):
    """Launch order: urgency, then how much a task holds up, bugs, and tasks that wait for others last."""
    tasks = table(spark, sf, "task").filter(F.col("status_key").isin("todo", "in_progress"))
    rows = tasks.join(blocks(spark, sf).withColumnRenamed("n", "blocks"), "task_id", "left").join(after(spark, sf).withColumn("waits", F.lit(True)), "task_id", "left").fillna(0, ["blocks"]).fillna(False, ["waits"])
    return R.top(rows, [X.priority_rank(F.col("priority")), -F.col("blocks"), F.col("type_key") != "bug", F.col("waits"), F.col("created_at"), F.col("task_id")], 100).select("task_id", "blocks", "waits")


@query(f"select task_id, row_number() over (order by {RANK_SQL}, created_at, task_id) as slot from task where status_key = 'todo' and retry_count < 3 qualify slot <= 4", ("task",))
def slot_limited_launch(spark, sf):
    """The free slots go to the first tasks that no rule skips; only those few are numbered."""
    first = R.top(table(spark, sf, "task").filter("status_key = 'todo' and retry_count < 3"), [X.priority_rank(F.col("priority")), F.col("created_at"), F.col("task_id")], 4)
    return first.select("task_id", F.row_number().over(Window.orderBy(X.priority_rank(F.col("priority")), "created_at", "task_id")).cast("long").alias("slot"))


COLUMN_SQL = "case when status_key in ('todo', 'blocked') then 'backlog' when status_key = 'in_progress' then 'progress' when status_key in ('in_review', 'in_testing') then 'checks' else 'closed' end"


@query(f"select {COLUMN_SQL} as board_column, count(*) as cards, count(*) filter (where type_key = 'bug') as bugs from task group by 1", ("task",))
def kanban_columns(spark, sf):
    return table(spark, sf, "task").groupBy(F.expr(COLUMN_SQL).alias("board_column")).agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("type_key") == "bug").alias("bugs"))


@query("select story_id, count(*) as total, count(*) filter (where status_key in ('done', 'canceled')) as closed from task group by 1", ("task",))
def story_lanes(spark, sf):
    return table(spark, sf, "task").groupBy("story_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_key").isin(*CLOSED)).alias("closed"))


@query(f"select task_id, row_number() over (partition by story_id order by -(10 * {RANK_SQL} + case when type_key = 'bug' then 4 else 0 end), code) as place from task", ("task",))
def board_order(spark, sf):
    """A board's bucket sorts the least urgent first, as the screen does."""
    weight = 10 * X.priority_rank(F.col("priority")) + F.when(F.col("type_key") == "bug", 4).otherwise(0)
    return table(spark, sf, "task").select("task_id", F.row_number().over(Window.partitionBy("story_id").orderBy(-weight, "code")).cast("long").alias("place"))


@query("select story_id, count(*) as tasks, cast(sum(coalesce(n, 0)) as bigint) as tokens from task left join (select task_id, sum(input_tokens + output_tokens + cache_tokens) as n from run group by 1) using (task_id) group by 1", ("task", "run"))
def story_tree_tokens(spark, sf):
    return _cards(spark, sf).groupBy("story_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum("tokens").alias("tokens"))


@query("select t.task_id, p.task_id as neighbour from task t join (select from_task, to_task from relation union select to_task, from_task from relation) r on r.from_task = t.task_id join task p on p.task_id = r.to_task where t.status_key = 'canceled' and p.status_key not in ('canceled', 'done') and p.type_key <> 'story'", ("task", "relation"))
def cascade_neighbours(spark, sf):
    """Whom a canceled task's end reaches: neighbours in either direction, each once, stories and closed ones left out."""
    edges = table(spark, sf, "relation").select(F.col("from_task").alias("a"), F.col("to_task").alias("b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    task = table(spark, sf, "task")
    ended = task.filter("status_key = 'canceled'").select(F.col("task_id").alias("a"))
    near = task.filter(~F.col("status_key").isin(*CLOSED) & (F.col("type_key") != "story")).select(F.col("task_id").alias("b"))
    return both.join(ended, "a").join(near, "b").select(F.col("a").alias("task_id"), F.col("b").alias("neighbour"))


@query("select task_id from task where status_key = 'in_progress' and not exists (select 1 from supplier where s_suppkey = task_id % 200 and s_acctbal > 0)", ("task",))
def unassigned_tasks(spark, sf):
    """Tasks in a work status that no live agent is assigned to."""
    live = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("agent"))
    return table(spark, sf, "task").filter("status_key = 'in_progress'").withColumn("agent", F.col("task_id") % 200).join(live, "agent", "left_anti").select("task_id")


@query("select t.task_id from task t join relation r on r.from_task = t.task_id and r.kind = 'blocked_by' join task b on b.task_id = r.to_task where t.status_key = 'blocked' group by 1 having count(*) filter (where b.status_key not in ('done', 'canceled')) = 0", ("task", "relation"))
def auto_unblock_candidates(spark, sf):
    """Blocked tasks with blockers, all of them closed."""
    blocked = table(spark, sf, "task").filter("status_key = 'blocked'").select("task_id")
    rel = table(spark, sf, "relation").filter("kind = 'blocked_by'")
    state = table(spark, sf, "task").select(F.col("task_id").alias("to_task"), F.col("status_key").isin(*CLOSED).alias("closed"))
    return rel.join(blocked, rel["from_task"] == blocked["task_id"]).join(state, "to_task").groupBy("task_id").agg(F.bool_and("closed").alias("all_closed")).filter("all_closed").select("task_id")
