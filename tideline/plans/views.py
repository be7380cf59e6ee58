"""Views that a person or an agent asks for: cards, histories, digests, bundles, and small labels in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import budgets
from ..operators import relational as R
from ..sources.adapter import table
from .catalog import query

LATEST = "started_at desc, attempt_no desc, session_id desc, input_tokens desc, output_tokens desc"


def _latest():
    return [F.desc(x.split()[0]) for x in LATEST.split(", ")]


@query("""select t.task_id, t.status_key, n_name as project, s.code as story_code, cast(coalesce(input, 0) as bigint) as input, cast(coalesce(output, 0) as bigint) as output, coalesce(blockers, 0) as blockers
  from task t join nation on n_nationkey = project_id left join (select story_id, min(code) as code from task group by 1) s on s.story_id = t.story_id left join (select task_id, sum(input_tokens) as input, sum(output_tokens) as output from run group by 1) u on u.task_id = t.task_id
  left join (select from_task, count(*) as blockers from relation join task b on b.task_id = to_task where kind = 'blocked_by' and b.status_key not in ('done', 'canceled') group by 1) k on k.from_task = t.task_id where t.task_id % 50 = 0""", ("task", "run", "relation"))
def task_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of the tasks asked for: the request's ids come first, so all else is narrowed by them."""
    task = table(spark, sf, "task")
    asked = task.filter("task_id % 50 = 0")
    ids = asked.select("task_id")
    used = table(spark, sf, "run").join(ids, "task_id", "left_semi").groupBy("task_id").agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))
    still = task.filter(~F.col("status_key").isin("done", "canceled")).select(F.col("task_id").alias("to_task"))
    held = table(spark, sf, "relation").filter("kind = 'blocked_by'").join(ids, F.col("from_task") == F.col("task_id"), "left_semi").join(still, "to_task", "left_semi").groupBy(F.col("from_task").alias("task_id")).agg(F.count(F.lit(1)).alias("blockers"))
    story = task.join(asked.select("story_id").distinct(), "story_id", "left_semi").groupBy("story_id").agg(F.min("code").alias("story_code"))
    project = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))
    rows = asked.join(project, "project_id").join(story, "story_id", "left").join(used, "task_id", "left").join(held, "task_id", "left")
    return rows.select("task_id", "status_key", "project", "story_code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("input", "output", "blockers")))


@query(f"select task_id, agent_id, s_name as agent, started_at, outcome from run join supplier on s_suppkey = agent_id order by {LATEST}, task_id limit 50", ("run",))
def run_history(spark, sf):
    first = R.top(table(spark, sf, "run"), [*_latest(), F.col("task_id")], 50)
    return first.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("agent_id")).select("task_id", "agent_id", F.col("s_name").alias("agent"), "started_at", "outcome")


@query("select event_id, user_id, ts from events where event_type = 'error' order by ts desc, event_id desc limit 200")
def chronicle_by_type(spark, sf):
    return R.top(table(spark, sf, "events").filter("event_type = 'error'"), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "user_id", "ts")


@query("""select t.task_id, b.code as blocker, b.status_key as blocker_status from task t join relation r on r.from_task = t.task_id join task b on b.task_id = r.to_task where t.status_key = 'blocked' and b.status_key not in ('done', 'canceled')""", ("task", "relation"))
def why_blocked(spark, sf):
    task = table(spark, sf, "task")
    blocked = task.filter("status_key = 'blocked'").select(F.col("task_id").alias("from_task"))
    open_tasks = task.filter(~F.col("status_key").isin("done", "canceled")).select(F.col("task_id").alias("to_task"), F.col("code").alias("blocker"), F.col("status_key").alias("blocker_status"))
    return table(spark, sf, "relation").join(blocked, "from_task", "left_semi").join(open_tasks, "to_task").select(F.col("from_task").alias("task_id"), "blocker", "blocker_status")


@query("""select conv_id, count(*) filter (where role = 'assistant') as done, count(*) filter (where role <> 'system') as total, arg_max(left(text, 150), turn) as last_text, string_agg(case when turn >= mt - 2 then role end, ' > ' order by turn) as recent
  from (select *, max(turn) over (partition by conv_id) as mt from conversations) group by 1""")
def task_digest(spark, sf):
    """Progress counts, the last entry's beginning, and the last three entries oldest first, in one aggregate."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("done"), F.count_if(F.col("role") != "system").alias("total"), F.max_by(F.left("text", F.lit(150)), "turn").alias("last_text"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("all"))
    last = F.filter("all", lambda x: x["turn"] >= F.element_at(F.col("all"), -1)["turn"] - 2)
    return rows.select("conv_id", "done", "total", "last_text", F.array_join(F.transform(last, lambda x: x["role"]), " > ").alias("recent"))


@query(f"""select task_id, string_agg(concat(outcome, ':', coalesce(reason_code, '-')), chr(10) order by {LATEST.replace(' desc', '')}) as note from (select * from run where outcome <> 'success' qualify row_number() over (partition by task_id order by {LATEST}) <= 8) group by 1""", ("run",))
def handoff_notes(spark, sf):
    """What the next agent is told: the last eight troubles of a task, oldest first."""
    rows = R.first_per(table(spark, sf, "run").filter("outcome <> 'success'"), ["task_id"], _latest(), 8, "back")
    line = F.concat("outcome", F.lit(":"), F.coalesce("reason_code", F.lit("-")))
    return rows.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("note"))


@query("""select c_custkey as story_id, concat('# ', c_name, chr(10), 'tasks: ', cast(count(o_orderkey) as varchar), chr(10), coalesce(string_agg(concat('- TK-', cast(o_orderkey as varchar), ' ', o_orderstatus), chr(10) order by o_orderdate desc, o_orderkey desc) filter (where rn <= 5), '')) as bundle
  from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) o on o_custkey = c_custkey group by 1, c_name""")
def context_bundle(spark, sf):
    """A story's context as one text: its head, counts and last five tasks."""
    recent = R.first_per(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5, "rn")
    line = F.concat(F.lit("- TK-"), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"))
    lines = recent.groupBy(F.col("o_custkey").alias("story_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("story_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("story_id"), "c_name").join(counts, "story_id", "left").join(lines, "story_id", "left")
    return rows.select("story_id", F.concat(F.lit("# "), "c_name", F.lit("\ntasks: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("bundle"))


# Characters of a story's text, and what each of its parts gets at least.
BUNDLE, BUNDLE_PART = 1600, 60


@query(f"""+ sized as (select *, length(line) + 1 as size, coalesce(sum(length(line) + 1) over (partition by story_id, part order by place rows between unbounded preceding and 1 preceding), 0) as before from bundle_line),
  parts as (select story_id, part, sum(size) as size, least(sum(size), {BUNDLE_PART}) as sure from sized group by 1, 2),
  shares as (select story_id, part, sure + greatest(0, least(size - sure, {BUNDLE} - sum(sure) over (partition by story_id) - coalesce(sum(size - sure) over (partition by story_id order by part rows between unbounded preceding and 1 preceding), 0))) as allotted from parts)
  select story_id, string_agg(substring(concat(line, chr(10)), 1, cast(allotted - before as integer)), '' order by part, place) as text, count(distinct part) as n_parts from sized join shares using (story_id, part) where before < allotted group by 1""", ("flow_version", "flow_transition", "project", "task", "relation", "run", "item", "artifact", "assignment", "bundle_line"))
def story_bundles(spark, sf):
    """All that an agent is told of a story: fifteen parts under one budget, never over it."""
    return budgets.bundles(table(spark, sf, "bundle_line"), "story_id", "part", "place", "line", BUNDLE, BUNDLE_PART)


@query("select 'no_live_agent' as warning, count(*) as n from supplier where s_acctbal < 0 union all select 'blocked_tasks', count(*) from task where status_key = 'blocked' union all select 'stale_runs', count(*) from run where finished_at is null and started_at < timestamp '1997-01-01'", ("task", "run"))
def pipeline_warnings(spark, sf):
    counts = {"no_live_agent": table(spark, sf, "supplier").filter("s_acctbal < 0"), "blocked_tasks": table(spark, sf, "task").filter("status_key = 'blocked'"), "stale_runs": table(spark, sf, "run").filter(F.col("finished_at").isNull() & (F.col("started_at") < F.lit("1997-01-01").cast("timestamp_ntz")))}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("warning"), "n") for k, d in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select task_id, status_key, case when task_id % 13 = 0 then 'no_status' when task_id % 5 > 1 then 'not_a_person' when task_id % 7 = 0 then 'reason_missing' else 'ok' end as code from task""", ("task",))
def force_decisions(spark, sf):
    """Moving a task by force: the target exists, the subject is a person, a reason is given; the first that fails."""
    known = F.when(F.col("task_id") % 13 == 0, F.lit("nowhere")).otherwise(F.lit("todo")).isin("todo", "in_progress", "done")
    person = F.element_at(F.array(*map(F.lit, ("human", "lead", "agent", "auto", "agent"))), (F.col("task_id") % 5 + 1).cast("int")).isin("human", "lead")
    reason = F.when(F.col("task_id") % 7 == 0, F.lit("  ")).otherwise(F.lit("because"))
    code = F.when(~known, "no_status").when(~person, "not_a_person").when(F.trim(reason) == "", "reason_missing").otherwise("ok")
    return table(spark, sf, "task").select("task_id", "status_key", code.alias("code"))


@query("""select task_id, agent_id, attempt_no, case when status_key in ('done', 'canceled') then 'stale_status' when reason_code = 'soft_turns' then 'soft_turns' when outcome = 'interrupted' then 'blocked' when reason_code = 'provider_unreachable' then 'provider_unreachable' when outcome = 'success' and retry_count < 2 then 'success' when outcome = 'success' then 'denied' else 'no_transition' end as applied, count(*) as n
  from run join task using (task_id) group by 1, 2, 3, 4""", ("run", "task"))
def report_outcomes(spark, sf):
    """What a run's report does to its task: the first branch that applies; success without a move burns the attempt."""
    rows = table(spark, sf, "run").join(table(spark, sf, "task").select("task_id", "status_key", "retry_count"), "task_id")
    good = F.col("outcome") == "success"
    applied = F.when(F.col("status_key").isin("done", "canceled"), "stale_status").when(F.col("reason_code") == "soft_turns", "soft_turns").when(F.col("outcome") == "interrupted", "blocked").when(F.col("reason_code") == "provider_unreachable", "provider_unreachable").when(good & (F.col("retry_count") < 2), "success").when(good, "denied").otherwise("no_transition")
    return rows.groupBy("task_id", "agent_id", "attempt_no", applied.alias("applied")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as task_id, case when o_orderpriority = '1-URGENT' or o_orderstatus = 'P' or o_custkey % 10 = 0 then 'todo' else 'pending' end as entry from orders")
def moderation_routing(spark, sf):
    """New tasks wait for a person, but for three kinds."""
    free = (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderstatus") == "P") | (F.col("o_custkey") % 10 == 0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(free, "todo").otherwise("pending").alias("entry"))


MESSAGES = ["Can't reach the API server now", "getaddrinfo EAI_AGAIN", "ENOTFOUND host", "connect ECONNREFUSED", "ETIMEDOUT", "read ECONNRESET", "TypeError: fetch failed", "econnrefused", "exit code 1", "timed out", "rate limit"]


@query(f"select event_id, regexp_matches(concat(event_type, ' ', [{', '.join(repr(m) if chr(39) not in m else chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39) for m in MESSAGES)}][cast(user_id % 11 as int) + 1]), 'Can.t reach the API server|EAI_AGAIN|ENOTFOUND|ECONNREFUSED|ETIMEDOUT|ECONNRESET|fetch failed') as down from events")
def provider_failures(spark, sf):
    """Messages that say that a provider could not be reached, by markers whose case counts."""
    said = F.concat("event_type", F.lit(" "), F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("user_id") % 11 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", L.unreachable(said).alias("down"))


@query("select event_id, case when k = 0 then '' when k >= 1000 then concat(cast(cast(floor(k / 1000 + 0.5) as bigint) as varchar), 'K') else cast(k as varchar) end as tokens, case when event_id % 10 = 1 and event_id % 100 <> 11 then 'one' when event_id % 10 between 2 and 4 and event_id % 100 not between 12 and 14 then 'few' else 'many' end as form from (select event_id, cast(floor(value * 37) as bigint) as k from events)")
def label_forms(spark, sf):
    n = F.floor(F.col("value") * 37)
    return table(spark, sf, "events").select("event_id", L.abbreviated(n).alias("tokens"), L.plural(F.col("event_id"), "one", "few", "many").alias("form"))


@query("""with raw as (select p_partkey, case when p_size % 7 = 0 then 'someone' else 'by_ai' end as author, unnest(range(6)) as i, case i when 0 then p_brand when 1 then p_type when 2 then p_brand when 3 then p_name when 4 then case when p_size % 5 = 0 then repeat('x', 65) else 'by_human' end else case when p_size % 3 = 0 then 'more' else '' end end as tag,
    list_contains(['x'], 'y') as never, p_size from part), extra as (select p_partkey, author, tag, min(i) as i from raw where tag <> '' and tag <> 'by_human' group by 1, 2, 3)
  select p_partkey, concat(author, '|', string_agg(tag, '|' order by i)) as tags, case when author = 'someone' then 'author' when max(length(tag)) > 64 then 'length' when count(*) > 4 then 'number' end as error from extra group by p_partkey, author""")
def tag_normalisation(spark, sf):
    """A task's tags: the author's first, then the others; and which rule they break."""
    more = F.array(F.concat(F.lit("#"), "p_brand"), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_brand"), F.concat(F.lit("##"), "p_name"), F.when(F.col("p_size") % 5 == 0, F.lit("x" * 65)).otherwise("#by_human"), F.when(F.col("p_size") % 3 == 0, "more").otherwise(" "))
    author = F.when(F.col("p_size") % 7 == 0, "someone").otherwise("by_ai")
    return table(spark, sf, "part").select("p_partkey", L.tags(author, more).alias("x")).select("p_partkey", F.array_join("x.tags", "|").alias("tags"), "x.error")


@query("select c_custkey, c_custkey % 4 < 2 as yes, concat('****', right(c_name, 4)) as shown, case when c_custkey % 2 = 0 then 'b/new.py' else 'a.py' end as path from customer")
def small_parsers(spark, sf):
    """Confirmations, masks, and paths of short status output."""
    said = F.expr("case c_custkey % 4 when 0 then ' Yes! ' when 1 then 'do it' when 2 then 'yes please' end")
    line = F.when(F.col("c_custkey") % 2 == 0, "R  a.py -> b/new.py").otherwise(" M a.py")
    return table(spark, sf, "customer").select("c_custkey", L.confirmed(said).alias("yes"), L.masked(F.col("c_name")).alias("shown"), L.changed_path(line).alias("path"))


# Labels of a flow's statuses, and words that hint at one where no label is said.
LABELS = [("in_review", "the re"), ("review_ready", "the rely"), ("todo", " the "), ("done", "enan"), ("blocked", "st. Th")]
WORDS = {"und": "in_testing", "der": "done", "les": "blocked"}


@query(f"""with label(key, label, n) as (values {", ".join(f"('{k}', '{x.strip().lower()}', {i})" for i, (k, x) in enumerate(LABELS))}), hit as (select doc_id, arg_max(key, length(label) * 100 - n) as guess from documents join label on contains(lower(text), label) group by 1)
  select d.doc_id, coalesce(guess, case when contains(lower(text), 'der') then 'done' when contains(lower(text), 'les') then 'blocked' end) as guess from documents d left join hit using (doc_id)""")
def status_guess(spark, sf):
    """The status that a text speaks of: its longest label, else the first hint to a status that the flow has."""
    labels = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(x).alias("label")) for k, x in LABELS))
    return table(spark, sf, "documents").select("doc_id", L.guessed(F.coalesce("text", F.lit("")), labels, WORDS).alias("guess"))


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by value, event_id) as i, count(*) over (partition by user_id) as n from events),
  p as (select user_id, n, least(greatest(0.95::double * (n + 1), 1), n - 1) as h from r group by 1, 2 having n > 1)
  select p.user_id, a.value + (b.value - a.value) * (0.95::double * (p.n + 1) - floor(h)) as p95 from p join r a on a.user_id = p.user_id and a.i = floor(h) join r b on b.user_id = p.user_id and b.i = floor(h) + 1""")
def latency_p95(spark, sf):
    """The 19th of the 19 cuts that part a user's values in twenty: the exclusive quantile, which may lie beyond the largest."""
    n, rank = F.col("n"), 0.95 * (F.col("n") + 1)
    low = F.floor(F.least(F.greatest(rank, F.lit(1.0)), F.col("n") - 1.0))
    rows = table(spark, sf, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n")).filter("n > 1")
    pair = rows.groupBy("user_id", "n").agg(F.max(F.when(F.col("i") == low, F.col("value"))).alias("a"), F.max(F.when(F.col("i") == low + 1, F.col("value"))).alias("b"))
    return pair.select("user_id", (F.col("a") + (F.col("b") - F.col("a")) * (0.95 * (n + 1) - low)).alias("p95"))


@query("select case when priority in ('critical', 'high') then 'fast' else 'slow' end as lane, type_key, count(*) as n from task group by grouping sets ((1, 2))", ("task",))
def lane_counts(spark, sf):
    lane = F.when(X.priority_rank(F.col("priority")) < 2, "fast").otherwise("slow")
    return table(spark, sf, "task").groupBy(lane.alias("lane"), "type_key").agg(F.count(F.lit(1)).alias("n"))
