"""Updates, appends and deletes as new states of tables: a join and a choice of columns instead of statements by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import sinks
from ..sources.adapter import table
from .catalog import query


@query("select event_id, event_type, false as added from events union all select (select max(event_id) from events) + row_number() over (order by o_orderkey), 'created', true from orders where o_orderstatus = 'P'")
def appended_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended behind a log, with ids that go on from its highest."""
    log = table(spark, sf, "events")
    last = log.agg(F.max("event_id").alias("last"))
    new = R.numbered(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(0).alias("all")), ["all"], [F.floor(F.col("o_orderkey") / (1 << 16))], [F.col("o_orderkey")])
    new = new.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("number")).alias("event_id"), F.lit("created").alias("event_type"), F.lit(True).alias("added"))
    return log.select("event_id", "event_type", F.lit(False).alias("added")).unionByName(new)


@query("select doc_id, concat('p-', sha256(cast(doc_id as varchar))) as payload_id, length(coalesce(text, '')) as size from documents where doc_id % 3 = 0")
def payloads_with_ids(spark, sf):
    """Rows whose ids are known before they are written: made from a key, so that a task that runs again makes the same."""
    made = table(spark, sf, "documents").filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("p-"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("payload_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return sinks.appended(made, "payloads")


@query("select task_id, agent_id, count(*) as runs, count(*) filter (where task_id in (select task_id from task where status_key = 'in_progress')) as touched from run where finished_at is null group by 1, 2", ("run", "task"))
def touched_heartbeats(spark, sf):
    """An update of the rows whose ids are in a list: a semi join's mark, and a choice."""
    active = table(spark, sf, "task").filter("status_key = 'in_progress'").select("task_id").withColumn("active", F.lit(True))
    rows = table(spark, sf, "run").filter("finished_at is null").join(active, "task_id", "left")
    return rows.groupBy("task_id", "agent_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce("active", F.lit(False))).alias("touched"))


@query("""+ patch as (select o_orderkey as task_id, kind, position, case when o_orderkey % 3 = 0 then concat('new ', cast(position as varchar)) end as text, 'closed' as status from orders cross join (values ('developer', 4), ('tester', 2), ('tester', 6)) p(kind, position) where o_orderkey % 2 = 0)
  select i.task_id, i.kind, i.position, coalesce(p.text, i.text) as text, coalesce(p.status, i.status) as status, p.task_id is not null as changed from item i left join patch p on p.task_id = i.task_id and p.kind = i.kind and p.position = i.position""", ("item",))
def item_updates(spark, sf):
    """Checklist items updated by task, kind and position; what the update has as null stays as it was."""
    places = spark.createDataFrame([("developer", 4), ("tester", 2), ("tester", 6)], "kind string, position int")
    patch = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("task_id")).crossJoin(F.broadcast(places))
    patch = patch.withColumn("new_text", F.when(F.col("task_id") % 3 == 0, F.concat(F.lit("new "), F.col("position").cast("string")))).withColumn("new_status", F.lit("closed"))
    rows = table(spark, sf, "item").join(patch, ["task_id", "kind", "position"], "left")
    return rows.select("task_id", "kind", "position", F.coalesce("new_text", "text").alias("text"), F.coalesce("new_status", "status").alias("status"), F.col("new_status").isNotNull().alias("changed"))


@query("select event_id, case when event_type = 'error' and user_id in (select user_id from events where event_type = 'purchase') then 'resolved' when event_type = 'error' then 'open' else 'none' end as state from events")
def resolved_notifications(spark, sf):
    """A bulk update by a condition: open notifications of those who came through are resolved."""
    through = table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id").distinct().withColumn("through", F.lit(True))
    error = F.col("event_type") == "error"
    return table(spark, sf, "events").join(through, "user_id", "left").select("event_id", F.when(error & F.col("through"), "resolved").when(error, "open").otherwise("none").alias("state"))


@query("""select task_id, kind, position, text, false as is_new from item where (task_id, kind) not in (select o_orderkey, 'psi' from orders where o_orderstatus = 'F') union all select o_orderkey, 'psi', i, concat('step ', cast(i as varchar)), true from orders cross join (values (0), (1)) v(i) where o_orderstatus = 'F'""", ("item",))
def replaced_checklists(spark, sf):
    """Delete all of a parent's rows and insert the new ones: an anti join by the parent, then a union."""
    replaced = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task_id"), F.lit("psi").alias("kind"))
    stays = table(spark, sf, "item").select("task_id", "kind", "position", "text", F.lit(False).alias("is_new")).join(replaced, ["task_id", "kind"], "left_anti")
    new = replaced.select("task_id", "kind", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).select("task_id", "kind", "position", F.concat(F.lit("step "), F.col("position").cast("string")).alias("text"), F.lit(True).alias("is_new"))
    return stays.unionByName(new)


@query("select o_orderkey as event_id, case when o_orderdate > timestamp '1997-01-01' then o_custkey end as payload_id, o_orderdate <= timestamp '1997-01-01' as purged from orders")
def purged_payloads(spark, sf):
    """Payloads that have run out go (their last moment included), and what refers to them forgets them."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("payload_id"), (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz")).alias("purged"))
    return rows.withColumn("payload_id", F.when(~F.col("purged"), F.col("payload_id")))


@query("select p_brand as tag, count(*) as n from part where p_brand not in (select p_brand from part join lineitem on l_partkey = p_partkey where l_quantity > 49.5) group by 1 union all select concat('type ', p_type), count(*) from part group by 1")
def tags_in_use(spark, sf):
    """Tags that nothing refers to any more are deleted; the others stay with their counts."""
    gone = table(spark, sf, "lineitem").filter("l_quantity > 49.5").select(F.col("l_partkey").alias("p_partkey")).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_brand").distinct()
    part = table(spark, sf, "part")
    brands = part.join(gone, "p_brand", "left_anti").groupBy(F.col("p_brand").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return brands.unionByName(part.groupBy(F.concat(F.lit("type "), "p_type").alias("tag")).agg(F.count(F.lit(1)).alias("n")))


@query("""select name, kind, count(*) as uses, count(distinct version_id) as versions from (select version_id, unnest(string_split(behaviors, ',')) as name, 'behaviour' as kind from flow_status union all select version_id, runner, 'runner' from flow_transition union all select version_id, gate, 'gate' from flow_status where gate is not null) x where name <> '' group by 1, 2""", ("flow_version", "flow_status", "flow_transition"))
def predicate_registry(spark, sf):
    """The registry of the names that flows use: behaviours, runners and gates, with their uses."""
    statuses, edges = table(spark, sf, "flow_status"), table(spark, sf, "flow_transition")
    parts = [statuses.select("version_id", F.explode(F.split("behaviors", ",")).alias("name"), F.lit("behaviour").alias("kind")), edges.select("version_id", F.col("runner").alias("name"), F.lit("runner").alias("kind")), statuses.filter("gate is not null").select("version_id", F.col("gate").alias("name"), F.lit("gate").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("name <> ''").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("version_id").alias("versions"))


@query("select name, n from (values ('documents', (select count(*) from documents)), ('events', (select count(*) from events)), ('lineitem', (select count(*) from lineitem)), ('nation', (select count(*) from nation)), ('orders', (select count(*) from orders))) v(name, n)")
def table_counts(spark, sf):
    """Every table of a catalogue with its number of rows."""
    names = ("documents", "events", "lineitem", "nation", "orders")
    return reduce(DataFrame.unionByName, (table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names))


@query("select event_id, ts < timestamp '2024-01-15' as expired from events")
def expired_sessions(spark, sf):
    """What has run out before a moment; the moment itself has not."""
    return table(spark, sf, "events").select("event_id", (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("expired"))


@query("select task_id, attempt_no, count(*) as n from run where finished_at is not null and outcome = 'interrupted' and finished_at >= timestamp '1998-06-01 00:00:00' - interval 10 day and finished_at <= timestamp '1998-06-01' and agent_id in (select agent_id from assignment) group by 1, 2", ("run", "assignment"))
def interrupted_lately(spark, sf):
    """Runs that a person ended within a window, of agents that are at work."""
    until = F.lit("1998-06-01").cast("timestamp_ntz")
    rows = table(spark, sf, "run").filter((F.col("outcome") == "interrupted") & (F.col("finished_at") >= until - F.expr("interval 10 days")) & (F.col("finished_at") <= until))
    return rows.join(table(spark, sf, "assignment").select("agent_id").distinct(), "agent_id", "left_semi").groupBy("task_id", "attempt_no").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, min(event_id) filter (where event_type = 'purchase') as ended_at, count(*) as seen from (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id) as last from events) where last is null or event_id <= last group by 1")
def ended_logs(spark, sf):
    """A log ends with its first end marker: nothing after it is read."""
    rows = table(spark, sf, "events").withColumn("last", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("user_id")))
    return rows.filter("last is null or event_id <= last").groupBy("user_id").agg(F.min("last").alias("ended_at"), F.count(F.lit(1)).alias("seen"))


@query("select cast(ts as date) as day, min(event_id) as first_event, count(*) as calls from events group by 1")
def once_a_day(spark, sf):
    """Of the calls of one UTC day the first does the work."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("calls"))


@query("select e.event_id, e.user_id, e.ts from events e left join (select user_id, max(event_id) as last from events where event_type = 'purchase' group by 1) p using (user_id) where event_type = 'error' and (last is null or event_id > last) order by ts desc, event_id limit 100")
def open_notifications(spark, sf):
    """The newest hundred of those still open: raised after what resolved the ones before."""
    rows = table(spark, sf, "events")
    through = rows.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    still = rows.filter("event_type = 'error'").join(through, "user_id", "left").filter("last is null or event_id > last")
    return R.top(still.select("event_id", "user_id", "ts"), [F.desc("ts"), F.col("event_id")], 100)


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type")
def activity_changes(spark, sf):
    """A user's activity is told only where it differs from what was told before."""
    rows = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("select tag, min(p_partkey) as first_part from (select p_brand as tag, p_partkey from part union all select p_type, p_partkey from part) where tag not in (select p_brand from part where p_size > 48) group by 1")
def new_tags(spark, sf):
    """Tags that a batch brings and that are not known yet, each once, from the first row that has it."""
    part = table(spark, sf, "part")
    asked = part.select(F.col("p_brand").alias("tag"), F.col("p_partkey").alias("first_part")).unionByName(part.select(F.col("p_type").alias("tag"), F.col("p_partkey").alias("first_part")))
    known = part.filter("p_size > 48").select(F.col("p_brand").alias("tag"))
    return asked.join(known.distinct(), "tag", "left_anti").groupBy("tag").agg(F.min("first_part").alias("first_part"))


@query("""+ i as (select task_id, string_agg(concat(kind, '#', cast(position as varchar), ' ', status), chr(10) order by kind, position, status, text) as items, count(*) as n_items from item group by 1), a as (select task_id, string_agg(concat(kind, ' v', cast(version as varchar)), ',' order by kind) as reports from (select task_id, kind, max(version) as version from artifact group by 1, 2) group by 1)
  select t.task_id, coalesce(items, '') as items, coalesce(n_items, 0) as n_items, coalesce(reports, '') as reports from task t left join i using (task_id) left join a using (task_id)""", ("task", "item", "artifact"))
def task_papers(spark, sf):
    """A task's checklists by kind and position, and its newest reports by kind."""
    line = F.concat("kind", F.lit("#"), F.col("position").cast("string"), F.lit(" "), "status")
    items = table(spark, sf, "item").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("kind", "position", "status", "text", line.alias("line")))).alias("x"), F.count(F.lit(1)).alias("n_items"))
    newest = table(spark, sf, "artifact").groupBy("task_id", "kind").agg(F.max("version").alias("version"))
    reports = newest.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "version"))), lambda r: F.concat(r["kind"], F.lit(" v"), r["version"].cast("string"))), ",").alias("reports"))
    rows = table(spark, sf, "task").select("task_id").join(items, "task_id", "left").join(reports, "task_id", "left")
    return rows.select("task_id", F.coalesce(F.array_join(F.transform("x", lambda v: v["line"]), "\n"), F.lit("")).alias("items"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("reports", F.lit("")).alias("reports"))
