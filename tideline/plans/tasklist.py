"""Task lists, searches and look-ups as users ask for them, each with its arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import tasks as T
from ..operators.rules import STAGES
from ..sources.adapter import table
from .catalog import query
from .decisions import current

VIEWS = ("task", "project", "card")
FLOW = (*VIEWS, "flow_version", "flow_status")
ORDER = "case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end, type_key <> 'bug', created_at, code"
OPEN = "not exists (select 1 from flow_status s join flow_version v using (version_id, type_key) where v.is_current and v.is_published and s.type_key = card.type_key and s.status_key = card.status_key and s.is_terminal is true)"


def cards(spark: SparkSession, sf: str, **arguments) -> DataFrame:
    return T.chosen(table(spark, sf, "card"), terminal=current(spark, sf, "flow_status"), **arguments)


def _columns(df: DataFrame) -> DataFrame:
    return df.select("task_id", "code", "mnemonic", "type_key", "status_key", "priority", "title", "created_at")


FIELDS = "task_id, code, mnemonic, type_key, status_key, priority, title, created_at"


@query(f"select {FIELDS} from card where mnemonic in ('P3', 'P4') and type_key in ('bug', 'story') order by {ORDER} limit 50", VIEWS)
def tasks_of_projects_and_types(spark, sf):
    return _columns(T.page(cards(spark, sf, projects=["p3", "P4"], types=["bug", "story"])))


@query(f"select {FIELDS} from card where title ilike '%000012%' or code ilike '000012%' order by {ORDER} limit 200", VIEWS)
def tasks_by_title(spark, sf):
    return _columns(T.page(cards(spark, sf, q="  000012 "), 200))


@query(f"select {FIELDS} from card where (title ilike '%tk-11%' or code ilike 'tk-11%') and {OPEN} order by {ORDER} limit 200", FLOW)
def open_tasks_by_code(spark, sf):
    return _columns(T.page(cards(spark, sf, q="tk-11", exclude_terminal=True), 200))


@query(f"select {FIELDS} from card where {OPEN} order by {ORDER} limit 200 offset 400", FLOW)
def open_tasks_third_page(spark, sf):
    """A blank search lets everything through."""
    return _columns(T.page(cards(spark, sf, q="   ", exclude_terminal=True), 200, 400))


@query(f"select {FIELDS} from card where status_key in ('in_review', 'in_testing') and mnemonic in ('P7', 'P8', 'P9', 'P10', 'P11', 'P12') and type_key in ('qa_task', 'bug') order by {ORDER} limit 10 offset 1", VIEWS)
def tasks_in_checks(spark, sf):
    return _columns(T.page(cards(spark, sf, projects=["p7", "P8", "p9", "p10", "p11", "p12"], types=["qa_task", "bug"], statuses=["in_review", "in_testing"]), 10, 1))


#: Arguments whose totals are shown beside pages.
TOTALS = {"all": {}, "blank": {"q": " "}, "bugs": {"types": ["bug"]}, "open": {"exclude_terminal": True}, "open bugs": {"types": ["bug"], "exclude_terminal": True}, "p1": {"projects": ["p1"]}, "nothing": {"projects": ["none"]}, "no list": {"types": []}}


@query(f"""select 'all' as asked, count(*) as total from card union all select 'blank', count(*) from card union all select 'bugs', count(*) from card where type_key = 'bug' union all select 'open', count(*) from card where {OPEN}
  union all select 'open bugs', count(*) from card where type_key = 'bug' and {OPEN} union all select 'p1', count(*) from card where mnemonic = 'P1' union all select 'nothing', 0 union all select 'no list', count(*) from card""", FLOW)
def task_totals(spark, sf):
    """How many tasks each set of arguments finds, without sorting."""
    return reduce(DataFrame.unionByName, (cards(spark, sf, **a).agg(F.count(F.lit(1)).alias("total")).select(F.lit(k).alias("asked"), "total") for k, a in TOTALS.items()))


@query("select code, type_key, status_key, title from card where mnemonic = 'P9' and status_key = 'blocked' and (title ilike '%order 1%' or code ilike '%order 1%') order by created_at desc, code limit 25", VIEWS)
def task_search(spark, sf):
    return T.found(table(spark, sf, "card"), "p9", "blocked", "ORDER 1").select("code", "type_key", "status_key", "title")


@query("select code, type_key, status_key, title from card where title ilike '%k-77%' or code ilike '%k-77%' order by created_at desc, code limit 25", VIEWS)
def task_search_by_code(spark, sf):
    """The search looks into the middle of codes too, which the list does not."""
    return T.found(table(spark, sf, "card"), q="k-77").select("code", "type_key", "status_key", "title")


@query("select task_id, code, title from card where task_id = 42", VIEWS)
def task_by_id(spark, sf):
    return T.at_most_one(table(spark, sf, "card"), task_id=42).select("task_id", "code", "title")


@query("select n_nationkey, n_name from nation where n_name = 'NATION_7' and n_regionkey = (select n_regionkey from nation where n_nationkey = 7)")
def project_by_name(spark, sf):
    """A look-up by any columns: no row or one, more are an error."""
    return T.at_most_one(table(spark, sf, "nation"), n_name="NATION_7").select("n_nationkey", "n_name")


@query("""select mnemonic, count(t.task_id) filter (where s.is_terminal is not true) as open_n from project p left join task t on t.project_id = p.project_id left join (select * from flow_version where is_current and is_published) v on v.type_key = t.type_key
  left join flow_status s on s.version_id = v.version_id and s.status_key = t.status_key group by 1""", FLOW)
def projects_status(spark, sf):
    """Open tasks by project through the chain of current version and status; a project without tasks has 0."""
    ended = current(spark, sf, "flow_status").filter("is_terminal").select("type_key", "status_key")
    counts = table(spark, sf, "task").join(ended, ["type_key", "status_key"], "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("open_n"))
    return table(spark, sf, "project").join(counts, "project_id", "left").select("mnemonic", F.coalesce("open_n", F.lit(0)).alias("open_n"))


@query("select t.task_id, t.code, s.code as story_code from task t left join (select story_id, min_by(code, task_id) as code from task where type_key = 'story' group by 1) s on s.story_id = t.story_id and t.type_key <> 'story'", ("task",))
def story_codes(spark, sf):
    """Each task with the code of its story, which is a task too; a story has none."""
    task = table(spark, sf, "task")
    story = task.filter("type_key = 'story'").groupBy("story_id").agg(F.min_by("code", "task_id").alias("story_code"))
    child = F.when(F.col("type_key") != "story", F.col("story_id"))
    return task.select("task_id", "code", child.alias("story_id")).join(story, "story_id", "left").select("task_id", "code", "story_code")


@query("select code, type_key, status_key, coalesce(tokens, 0) as tokens, cast(row_number() over (partition by type_key order by status_key, code) as bigint) as place from task left join (select task_id, cast(sum(input_tokens + output_tokens) as bigint) as tokens from run group by 1) using (task_id)", ("task", "run"))
def task_index(spark, sf):
    """All tasks with their tokens, by type, status and code: places are numbered within a type by ranges of statuses."""
    used = table(spark, sf, "run").groupBy("task_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    rows = table(spark, sf, "task").join(used, "task_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    order = [F.col("status_key"), F.col("code")]
    return R.numbered(rows, ["type_key"], [F.col("status_key"), F.left("code", F.lit(6))], order, "place").select("code", "type_key", "status_key", "tokens", "place")


@query("select code, title from card where status_key = 'blocked' order by code limit 5", VIEWS)
def five_blocked(spark, sf):
    """A limit gets a total order, so that the same five come back."""
    return table(spark, sf, "card").filter("status_key = 'blocked'").orderBy("code").limit(5).select("code", "title")


@query("select task_id, cast(row_number() over (order by runs_reset_at nulls last, code) as bigint) as place from task order by runs_reset_at nulls last, code limit 100", ("task",))
def resets_first(spark, sf):
    """Nulls come last; only the page is numbered."""
    order = [F.col("runs_reset_at").asc_nulls_last(), F.col("code")]
    first = table(spark, sf, "task").orderBy(*order).limit(100)
    return first.select("task_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("select task_id, stage from (select task_id, code, case status_key when 'todo' then 2 when 'in_progress' then 3 when 'in_review' then 4 when 'in_testing' then 5 when 'done' then 6 else 99 end as stage from task) order by stage, code limit 100", ("task",))
def by_stage(spark, sf):
    """Sorted by the stage's rank; a status without one comes after all others."""
    ranks = F.create_map(*(F.lit(x) for k, v in STAGES.items() for x in (k, v)))
    rows = table(spark, sf, "task").withColumn("stage", F.coalesce(ranks[F.col("status_key")], F.lit(99)))
    return rows.orderBy("stage", "code").limit(100).select("task_id", "stage")


@query("select task_id, coalesce(case when task_id % 4 = 0 then '' when task_id % 4 = 1 then priority end, '') <> '' as has_text from task", ("task",))
def has_text(spark, sf):
    """Null and empty texts are both none."""
    said = F.when(F.col("task_id") % 4 == 0, "").when(F.col("task_id") % 4 == 1, F.col("priority"))
    return table(spark, sf, "task").select("task_id", (F.coalesce(said, F.lit("")) != "").alias("has_text"))


@query("select task_id, runs_reset_at is not null and created_at <> runs_reset_at as conflict from task", ("task",))
def edit_conflicts(spark, sf):
    """Whether someone wrote since the editor read: only flagged, the last write wins."""
    return table(spark, sf, "task").select("task_id", (F.col("runs_reset_at").isNotNull() & (F.col("created_at") != F.col("runs_reset_at"))).alias("conflict"))


@query("select event_type, count(*) filter (where event_type like 'c%') as begins, count(*) filter (where props not like '%1%') as lacks from events group by 1")
def like_patterns(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.startswith("event_type", F.lit("c"))).alias("begins"), F.count_if(~F.contains("props", F.lit("1"))).alias("lacks"))


@query("select n_nationkey, r_regionkey, n_regionkey = r_regionkey as own from nation cross join region")
def regions_by_nation(spark, sf):
    """A product of two tables of fixed, small size."""
    return table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "region"))).select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


#: Columns of the board by type and status, as data.
COLUMNS = [(t, s, c) for t in ("story", "bug", "qa_task", "analyse_task", "common_task") for s, c in (("todo", "backlog"), ("in_progress", "progress"), ("in_review", "checks"), ("in_testing", "checks"), ("done", "closed")) if (t, s) != ("bug", "todo")]


@query(f"select board_column, count(*) as cards from task left join (values {', '.join(map(str, COLUMNS))}) c(type_key, status_key, board_column) using (type_key, status_key) group by 1", ("task",))
def mapped_columns(spark, sf):
    """The board's columns by a map from type and status; what the map lacks is in no column."""
    known = spark.createDataFrame(COLUMNS, "type_key string, status_key string, board_column string")
    return table(spark, sf, "task").join(F.broadcast(known), ["type_key", "status_key"], "left").groupBy("board_column").agg(F.count(F.lit(1)).alias("cards"))


@query("""select n.task_id, case when active then 'working' when blocked then 'blocked' else 'waiting' end as part from (select t.task_id, t.status_key = 'blocked' as blocked, coalesce(r.live, false) as active from task t left join
  (select task_id, bool_or(finished_at is null) as live from run group by 1) r using (task_id) where status_key not in ('done', 'canceled')) n""", ("task", "run"))
def queue_parts(spark, sf):
    """The queue's snapshot in three parts: worked on now, blocked, waiting."""
    live = table(spark, sf, "run").groupBy("task_id").agg(F.bool_or(F.col("finished_at").isNull()).alias("live"))
    rows = table(spark, sf, "task").filter(~F.col("status_key").isin("done", "canceled")).join(live, "task_id", "left")
    return rows.select("task_id", F.when(F.col("live"), "working").when(F.col("status_key") == "blocked", "blocked").otherwise("waiting").alias("part"))


@query("select t.task_id, t.code, n.project from task t left join project n on n.project_id = t.project_id where not n.is_archived", ("task", "project"))
def tasks_of_live_projects(spark, sf):
    """An outer join whose filter refuses nulls: the optimiser makes it an inner one."""
    project = table(spark, sf, "project").select("project_id", "project", "is_archived")
    return table(spark, sf, "task").join(project, "project_id", "left").filter(~F.col("is_archived")).select("task_id", "code", "project")
