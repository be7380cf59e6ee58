"""Relations to their end, searches by index, exact quantiles of large keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, quantiles, trigrams
from ..session import new_path
from ..sources.adapter import table
from .catalog import query

#: Every fiftieth customer's oldest task waits for its newest: a cycle.
RINGS_SQL = """links as (select from_task as a, to_task as b from relation union all select first, last from (select story_id, arg_min(task_id, (created_at, task_id)) as first, arg_max(task_id, (created_at, task_id)) as last, count(*) as n from task group by 1) where story_id % 50 = 0 and n > 1)"""


def links(spark, sf):
    at = F.struct("created_at", "task_id")
    rings = table(spark, sf, "task").groupBy("story_id").agg(F.min_by("task_id", at).alias("a"), F.max_by("task_id", at).alias("b"), F.count(F.lit(1)).alias("n")).filter("story_id % 50 = 0 and n > 1").select("a", "b")
    return table(spark, sf, "relation").select(F.col("from_task").alias("a"), F.col("to_task").alias("b")).unionByName(rings)


@query(f"""+ {RINGS_SQL}, way(a, b, steps) as (select a, b, 1 from links union select w.a, l.b, steps + 1 from way w join links l on l.a = w.b where steps < (select max(n) from (select count(*) as n from task group by story_id))),
  least as (select a, b, min(steps) as steps from way group by 1, 2)
  select t.task_id, count(b) as before, cast(coalesce(max(steps), 0) as integer) as depth, count(*) filter (where o.status_key not in ('done', 'canceled')) as open_before, coalesce(bool_or(a = b), false) as cyclic from task t left join least on a = t.task_id left join task o on o.task_id = b group by 1""", ("task", "relation"))
def transitive_relations(spark, sf):
    """How many tasks stand before a task, directly or not, how far back the last of them is, how many are open, and cycles."""
    ways, _ = graphs.reachable(links(spark, sf))
    still = table(spark, sf, "task").filter(~F.col("status_key").isin("done", "canceled")).select(F.col("task_id").alias("b"), F.lit(1).alias("open"))
    counts = ways.join(still, "b", "left").groupBy(F.col("a").alias("task_id")).agg(F.count(F.lit(1)).alias("before"), F.max("steps").alias("depth"), F.count("open").alias("open_before"), F.bool_or(F.col("a") == F.col("b")).alias("cyclic"))
    return table(spark, sf, "task").select("task_id").join(counts, "task_id", "left").fillna(0, ["before", "depth", "open_before"]).fillna(False, ["cyclic"])


@query("+ place as (select task_id, row_number() over (partition by story_id order by created_at, task_id) - 1 as n from task) select task_id as node, n as steps from place where task_id in (select from_task from relation union all select to_task from relation)", ("task", "relation"))
def chain_lengths(spark, sf):
    """How many tasks stand before each in its chain, with one row a task in every round."""
    found, _ = graphs.chains(table(spark, sf, "relation").select(F.col("from_task").alias("a"), F.col("to_task").alias("b")))
    return found.select("node", "steps")


NEEDLES = (2, 3, 6, 12)


@query(f"""with needles as (select distinct n as size, lower(substring(text, 6, n)) as needle from benchmark, (select unnest({list(NEEDLES)}) as n) x where text is not null), d as materialized (select doc_id, lower(text) as t from documents)
  select size, needle, count(doc_id) as found, min(doc_id) as first, max(doc_id) as last from needles left join d on contains(t, needle) group by 1, 2""")
def indexed_search(spark, sf):
    """Needles of 2 to 12 characters looked for in whole texts by the index of trigrams."""
    path = new_path(spark, "trigrams")
    trigrams.build(table(spark, sf, "documents"), "doc_id", "text", path, 64)
    sizes = F.explode(F.array(*map(F.lit, NEEDLES))).alias("size")
    needles = table(spark, sf, "benchmark").filter("text is not null").select("text", sizes).select("size", F.lower(F.expr("substring(text, 6, size)")).alias("needle")).distinct()
    found = trigrams.search(spark, path, needles).groupBy("needle").agg(F.count(F.lit(1)).alias("found"), F.min("id").alias("first"), F.max("id").alias("last"))
    return needles.join(found, "needle", "left").fillna(0, ["found"]).select("size", "needle", "found", "first", "last")


@query("""with keyed as (select event_type as key, value from events union all select 'all', value from events), numbered as (select *, row_number() over (partition by key order by value) as r, count(*) over (partition by key) as n from keyed where value is not null),
  placed as (select distinct key, n, 0.95 * (n + 1) as at, least(greatest(cast(floor(0.95 * (n + 1)) as bigint), 1), greatest(n - 1, 1)) as low from numbered)
  select p.key, p.n, a.value + cast(p.at - p.low as double) * (b.value - a.value) as p95 from placed p join numbered a on a.key = p.key and a.r = p.low join numbered b on b.key = p.key and b.r = least(p.low + 1, p.n)""")
def exact_quantiles(spark, sf):
    """The exclusive 95th percentile by kind and of all values under one key, by counts of ranges."""
    rows = table(spark, sf, "events").select(F.explode(F.array("event_type", F.lit("all"))).alias("key"), "value")
    return quantiles.exclusive(rows, ["key"], "value", 0.95).select("key", "n", F.col("value").alias("p95"))
