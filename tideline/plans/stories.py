"""Stories and what hangs on them: versions that follow their tasks, foreign codes, acceptance with staleness, checked imports, shown rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, reports
from ..operators.rules import PREDICATES
from ..sources.adapter import table
from .catalog import query
from .drafts import PROBLEMS, VIEWS, drafts


@query("select c_custkey as story_id, cast(1 + coalesce(sum(ref_version), 0) as bigint) as version, count(task_id) as tasks, sha256(concat(c_name, '|', coalesce(string_agg(concat(code, ':', cast(ref_version as varchar)), ',' order by code), ''))) as ref_hash from customer left join task on story_id = c_custkey group by c_custkey, c_name", ("task",))
def story_versions(spark, sf):
    """A story's reference version goes up by one with each task that is added (a task's first version) or edited (its further ones)."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name").join(table(spark, sf, "task").select("story_id", "task_id", "code", "ref_version"), F.col("c_custkey") == F.col("story_id"), "left")
    mark = F.concat_ws("", "code", F.lit(":"), F.col("ref_version").cast("string"))  # a story without tasks has one mark, of nothing
    marks = F.array_join(F.array_sort(F.collect_list(F.struct("code", mark.alias("mark"))))["mark"], ",")
    stories = rows.groupBy("c_custkey", "c_name").agg(F.sum("ref_version").alias("edits"), F.count("task_id").alias("tasks"), marks.alias("marks"))
    return stories.select(F.col("c_custkey").alias("story_id"), (1 + F.coalesce("edits", F.lit(0))).cast("long").alias("version"), "tasks", F.sha2(F.concat_ws("", "c_name", F.lit("|"), "marks"), 256).alias("ref_hash"))


@query("""+ delta as (select l_orderkey as task_id, l_linenumber as position, l_partkey, case l_partkey % 4 when 0 then l_orderkey when 1 then l_orderkey + 1 when 2 then l_orderkey - 1 end as linked from lineitem),
  judged as (select t.story_id, d.*, case when linked is null then 'common' when o.task_id is null then 'unknown' when o.story_id <> t.story_id then 'foreign' else 'accepted' end as outcome from delta d join task t on t.task_id = d.task_id left join task o on o.task_id = d.linked)
  select story_id, outcome, count(*) as items, count(distinct linked) as codes from judged group by 1, 2""", ("task",))
def foreign_codes(spark, sf):
    """Items of a story's delta that name another story's task, or none that exists, are refused; those without a code are common."""
    delta = table(spark, sf, "lineitem").selectExpr("l_orderkey as task_id", "case l_partkey % 4 when 0 then l_orderkey when 1 then l_orderkey + 1 when 2 then l_orderkey - 1 end as linked")
    of = table(spark, sf, "task").select("task_id", "story_id")
    judged = delta.join(of, "task_id").join(of.select(F.col("task_id").alias("linked"), F.col("story_id").alias("other")), "linked", "left")
    outcome = F.when(F.col("linked").isNull(), "common").when(F.col("other").isNull(), "unknown").when(F.col("other") != F.col("story_id"), "foreign").otherwise("accepted")
    return judged.withColumn("outcome", outcome).groupBy("story_id", "outcome").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("linked").alias("codes"))


@query("""+ plan as (select task_id, max(ref) as stamp, count(*) as items, count(*) filter (where status in ('done', 'closed')) as passed, count(*) filter (where status = 'failed') as failed, string_agg(concat(case when status in ('done', 'closed') then '+ ' when status = 'failed' then '- ' else '? ' end, text), chr(10) order by position, text, status) as lines from item where kind = 'psi' group by 1)
  select t.task_id, ref_version, stamp, case when stamp is null then 'none' when stamp < ref_version then 'stale' else 'fresh' end as state, coalesce(items, 0) as items, coalesce(passed, 0) as passed, coalesce(failed, 0) as failed,
    concat('# ', code, ' acceptance', case when stamp < ref_version then concat(' (plan of version ', cast(stamp as varchar), ', task is at ', cast(ref_version as varchar), ')') else '' end, chr(10), coalesce(lines, 'no plan')) as document from task t left join plan on plan.task_id = t.task_id""", ("task", "item"))
def acceptance_documents(spark, sf):
    """A task's acceptance document as it is shown: its items with their marks, and whether the plan is older than the task."""
    mark = F.when(F.col("status").isin("done", "closed"), "+ ").when(F.col("status") == "failed", "- ").otherwise("? ")
    line = F.struct("position", "text", "status", F.concat(mark, "text").alias("line"))
    plan = table(spark, sf, "item").filter("kind = 'psi'").groupBy("task_id").agg(F.max("ref").alias("stamp"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("status").isin("done", "closed")).alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.array_join(F.array_sort(F.collect_list(line))["line"], "\n").alias("lines"))
    rows = table(spark, sf, "task").join(plan, "task_id", "left")
    old = F.col("stamp") < F.col("ref_version")
    note = F.when(old, F.concat(F.lit(" (plan of version "), F.col("stamp").cast("string"), F.lit(", task is at "), F.col("ref_version").cast("string"), F.lit(")"))).otherwise("")
    state = F.when(F.col("stamp").isNull(), "none").when(old, "stale").otherwise("fresh")
    document = F.concat(F.lit("# "), "code", F.lit(" acceptance"), note, F.lit("\n"), F.coalesce("lines", F.lit("no plan")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("task_id", "ref_version", "stamp", state.alias("state"), zero("items"), zero("passed"), zero("failed"), document.alias("document"))


@query(f"{PROBLEMS}, bad as (select draft, count(*) as errors from found where level = 'error' group by 1) select d.draft, cast(coalesce(errors, 0) as bigint) as errors, case when errors is null then 'imported' else 'refused' end as outcome, case when errors is null then (select count(*) from s where s.draft = d.draft) else 0 end as statuses from (select distinct draft from s) d left join bad using (draft)", VIEWS)
def checked_imports(spark, sf):
    """Flows exported as JSON, read again, and imported only if their check finds no error."""
    statuses, edges = drafts(spark, sf)
    texts = statuses.groupBy("draft").agg(F.to_json(F.collect_list(F.struct(*(c for c in statuses.columns if c != "draft")))).alias("s")).join(edges.groupBy("draft").agg(F.to_json(F.collect_list(F.struct(*(c for c in edges.columns if c != "draft")))).alias("e")), "draft", "left")
    listed = lambda df: f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema.fields if f.name != 'draft')}>>"
    nodes = texts.select("draft", F.inline(F.from_json("s", listed(statuses))))
    links = texts.filter("e is not null").select("draft", F.inline(F.from_json("e", listed(edges))))
    bad = flows.problems(nodes, links, tuple(PREDICATES), 8).filter("level = 'error'").groupBy("draft").agg(F.count(F.lit(1)).alias("errors"))
    counts = nodes.groupBy("draft").agg(F.count(F.lit(1)).alias("n")).join(bad, "draft", "left")
    good = F.col("errors").isNull()
    return counts.select("draft", F.coalesce("errors", F.lit(0)).alias("errors"), F.when(good, "imported").otherwise("refused").alias("outcome"), F.when(good, F.col("n")).otherwise(0).alias("statuses"))


@query("""select cast(row_number() over (order by n_name) as bigint) as place, concat('{"n_name":"', n_name, '","suppliers":', cast(suppliers as varchar), '}') as line from (select n_name, count(s_suppkey) as suppliers from nation left join supplier on s_nationkey = n_nationkey group by 1 order by 1 limit 50) x""")
def shown_rows(spark, sf):
    """A person's read-only statement: what it does is told by its plan, its rows are capped at fifty and shown as JSON texts."""
    rows = reports.read_only(spark, "select n_name, count(s_suppkey) as suppliers from {nation} left join {supplier} on s_nationkey = n_nationkey group by 1 order by 1", nation=table(spark, sf, "nation"), supplier=table(spark, sf, "supplier"))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct("n_name", F.to_json(F.struct("n_name", "suppliers")).alias("line")))).alias("x"))  # fifty rows at most
    return lines.select(F.posexplode("x").alias("place", "x")).select((F.col("place") + 1).cast("long").alias("place"), "x.line")
