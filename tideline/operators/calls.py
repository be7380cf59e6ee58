"""Table functions by argument, callable from SQL: card of a task, tree of a story, tasks of a project that have a text.

They are SQL functions over temporary views, so a call for each row of a table of arguments (a lateral join) is planned as
one join in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "task_card": """(wanted string) returns table (code string, title string, status_key string, priority string, project string, n_items bigint, n_closed bigint, n_open_blockers bigint) return
      select c.code, c.title, c.status_key, c.priority, c.project, coalesce(i.n, 0), coalesce(i.n_closed, 0), coalesce(b.n, 0) from call_card c
      left join (select task_id, count(*) as n, count_if(status in ('done', 'closed')) as n_closed from call_item group by task_id) i on i.task_id = c.task_id
      left join (select r.from_task, count(*) as n from call_relation r join call_card o on o.task_id = r.to_task where r.kind = 'blocked_by' and o.status_key not in ('done', 'canceled') group by r.from_task) b on b.from_task = c.task_id
      where c.code = upper(trim(task_card.wanted))""",
    "story_tree": """(story bigint) returns table (level int, place bigint, line string) return
      select 0, cast(0 as bigint), concat('story ', cast(story_id as string), ': ', cast(count(*) as string), ' tasks') from call_card where story_id = story_tree.story group by story_id
      union all select 1, task_id, concat(code, ' ', status_key) from call_card where story_id = story_tree.story
      union all select 2, r.from_task, concat(c.code, ' ', r.kind, ' ', cast(r.to_task as string)) from call_relation r join call_card c on c.task_id = r.from_task where c.story_id = story_tree.story""",
    "tasks_search": """(project bigint, needle string, status string) returns table (code string, title string) return
      select code, title from call_card where project_id = tasks_search.project and contains(lower(title), lower(tasks_search.needle)) and (tasks_search.status is null or status_key = tasks_search.status)""",
}


def register(spark: SparkSession, card: DataFrame, item: DataFrame, relation: DataFrame) -> None:
    """Makes the functions known to the session, over the given tables."""
    for name, df in (("card", card), ("item", item), ("relation", relation)):
        df.createOrReplaceTempView(f"call_{name}")
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
