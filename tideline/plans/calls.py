"""Table functions called for tables of arguments, and JSON columns of unlike shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, variants
from ..sources.adapter import table
from .catalog import query


def known(spark, sf):
    calls.register(spark, table(spark, sf, "card"), table(spark, sf, "item"), table(spark, sf, "relation"))


@query("""+ i as (select task_id, count(*) as n, count(*) filter (where status in ('done', 'closed')) as n_closed from item group by 1), b as (select from_task, count(*) as n from relation join card o on o.task_id = to_task where kind = 'blocked_by' and o.status_key not in ('done', 'canceled') group by 1)
  select concat(' tk-', cast(c.task_id as varchar), ' ') as wanted, c.code, c.title, c.status_key, c.priority, c.project, coalesce(i.n, 0) as n_items, coalesce(i.n_closed, 0) as n_closed, coalesce(b.n, 0) as n_open_blockers from card c left join i using (task_id) left join b on b.from_task = c.task_id where c.status_key = 'blocked'""", ("project", "task", "card", "item", "relation"))
def called_cards(spark, sf):
    """task_card() for every blocked task's code as a person writes it."""
    known(spark, sf)
    wanted = table(spark, sf, "task").filter("status_key = 'blocked'").select(F.concat(F.lit(" tk-"), F.col("task_id").cast("string"), F.lit(" ")).alias("wanted"))
    return spark.sql("select a.wanted, c.* from {wanted} a, lateral task_card(a.wanted) c", wanted=wanted)


@query("""+ tree as (select story_id, 0 as level, cast(0 as bigint) as place, concat('story ', cast(story_id as varchar), ': ', cast(count(*) as varchar), ' tasks') as line from card group by 1 union all select story_id, 1, task_id, concat(code, ' ', status_key) from card
  union all select story_id, 2, from_task, concat(code, ' ', kind, ' ', cast(to_task as varchar)) from relation join card on task_id = from_task) select c_custkey as story_id, level, place, line from customer join tree on story_id = c_custkey where c_mktsegment = 'BUILDING'""", ("project", "task", "card", "relation"))
def called_trees(spark, sf):
    """story_tree() for every story of one kind."""
    known(spark, sf)
    stories = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("story_id"))
    return spark.sql("select a.story_id, t.* from {stories} a, lateral story_tree(a.story_id) t", stories=stories)


@query("""+ asked as (select n_nationkey as project, concat('#', '00000', right(cast(10000 + n_nationkey as varchar), 3)) as needle, case when n_nationkey % 2 = 0 then 'done' end as status from nation)
  select a.project, a.needle, c.code, c.title from asked a join card c on c.project_id = a.project and contains(lower(c.title), lower(a.needle)) and (a.status is null or c.status_key = a.status)""", ("project", "task", "card"))
def called_searches(spark, sf):
    """tasks_search() for a table of projects, needles and statuses, of which some are null."""
    known(spark, sf)
    asked = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as project", "concat('#', '00000', right(cast(10000 + n_nationkey as string), 3)) as needle", "case when n_nationkey % 2 = 0 then 'done' end as status")
    return spark.sql("select cast(a.project as int) as project, a.needle, t.* from {asked} a, lateral tasks_search(a.project, a.needle, a.status) t", asked=asked)


TEXT = """case o_orderkey % 7 when 0 then concat('{"status": {"from": "', o_orderstatus, '", "to": null}, "n": ', cast(o_custkey as varchar(20)), '}') when 1 then '[1, "two", 3.5, {"a": true}]' when 2 then concat('"', o_orderpriority, '"') when 3 then '{"status": ' when 4 then 'null'
  when 5 then concat('{"tags": ["x", "', o_orderstatus, '"], "done": ', case when o_orderstatus = 'F' then 'true' else 'false' end, '}') end"""


@query(f"""with raw as (select 'props' as column_name, props as t from events union all select 'diff', {TEXT} from orders), good as (select column_name, case when json_valid(t) then t end as t, t is not null as given from raw),
  one as (select column_name, '$' as path, case when t is null then 'malformed' else json_type(t) end as type from good where given),
  l1 as (select column_name, concat('$.', k) as path, json_extract(t, concat('$."', k, '"')) as v from (select column_name, t, unnest(json_keys(t)) as k from good where json_type(t) = 'OBJECT') x union all select column_name, '$[]', unnest(json_extract(t, '$[*]')) from good where json_type(t) = 'ARRAY'),
  l2 as (select column_name, concat(path, '.', k) as path, json_extract(v, concat('$."', k, '"')) as v from (select column_name, path, v, unnest(json_keys(v)) as k from l1 where json_type(v) = 'OBJECT') x union all select column_name, concat(path, '[]'), unnest(json_extract(v, '$[*]')) from l1 where json_type(v) = 'ARRAY'),
  every as (select * from one union all select column_name, path, json_type(v) from l1 union all select column_name, path, json_type(v) from l2)
  select column_name, path, case type when 'malformed' then type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, count(*) as n from every group by 1, 2, 3""")
def json_shapes(spark, sf):
    """Values of two JSON columns by path and type, malformed ones counted."""
    rows = table(spark, sf, "events").selectExpr("'props' as column_name", "props as t").unionByName(table(spark, sf, "orders").selectExpr("'diff' as column_name", f"{TEXT} as t"))
    return variants.shapes(rows, "t", ["column_name"])


@query(f"""with v as (select o_orderkey, {TEXT} as t from orders), g as (select o_orderkey, case when json_valid(t) then t end as t from v)
  select o_orderkey, json_extract_string(t, '$.status.from') as was, try_cast(json_extract_string(t, '$.n') as bigint) as n, json_extract_string(t, '$.tags[1]') as second_tag, json_extract_string(t, '$[1]') as second from g""")
def variant_fields(spark, sf):
    """Fields of a JSON column by path; where the shape is another one there is null."""
    get = lambda path, kind, name: F.expr(f"try_variant_get(v, '{path}', '{kind}')").alias(name)
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(f"try_parse_json({TEXT})").alias("v"))
    return rows.select("o_orderkey", get("$.status.from", "string", "was"), get("$.n", "bigint", "n"), get("$.tags[1]", "string", "second_tag"), get("$[1]", "string", "second"))
