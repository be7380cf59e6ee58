"""Small functions over whole tables: diff statistics, times, casts, maps, sets, blocks of text, checks of fields."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import reports
from ..sources.adapter import table
from .catalog import query

STAT_SQL = "select l_orderkey as task_id, string_agg(concat(' src/', cast(l_partkey as varchar), '.py | ', cast(l_linenumber as varchar), ' +-'), chr(10) order by l_partkey, l_linenumber) as body, count(*) as files, cast(sum(l_linenumber) as bigint) as ins, cast(count(*) filter (where l_returnflag = 'R') as bigint) as del from lineitem group by 1"


def _stats(spark: SparkSession, sf: str):
    """A task's statistics as the command prints them, in JSON; a part that is zero is not printed."""
    line = F.concat(F.lit(" src/"), F.col("l_partkey").cast("string"), F.lit(".py | "), F.col("l_linenumber").cast("string"), F.lit(" +-"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", line.alias("line")))).alias("lines"), F.count(F.lit(1)).alias("files"), F.sum("l_linenumber").alias("ins"), F.count_if(F.col("l_returnflag") == "R").alias("del"))
    n = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) > 1, "s").otherwise(""))
    total = F.concat(F.lit(" "), n("files", "file"), F.lit(" changed, "), n("ins", "insertion"), F.lit("(+)"), F.when(F.col("del") > 0, F.concat(F.lit(", "), n("del", "deletion"), F.lit("(-)"))).otherwise(""))
    return rows.select("task_id", F.to_json(F.struct(F.concat_ws("\n", F.transform("lines", lambda x: x["line"]), total).alias("stat"))).alias("diff_stats"))


@query(f"select task_id, array_to_string(string_split(body, chr(10))[1:4], chr(10)) || case when files < 4 then chr(10) || concat(' ', files, ' file', case when files > 1 then 's' else '' end, ' changed, ', ins, ' insertion', case when ins > 1 then 's' else '' end, '(+)', case when del > 0 then concat(', ', del, ' deletion', case when del > 1 then 's' else '' end, '(-)') else '' end) else '' end as head, files, ins as insertions, del as deletions from ({STAT_SQL})")
def diff_stats(spark, sf):
    """The first four lines of a stored statistic, and its totals read back from its last line."""
    stat = F.get_json_object("diff_stats", "$.stat")
    lines = F.split(stat, "\n")
    number = lambda word: F.coalesce(F.regexp_extract(F.element_at(lines, -1), rf"(\d+) {word}", 1).try_cast("long"), F.lit(0))
    return _stats(spark, sf).select("task_id", F.array_join(F.slice(lines, 1, 4), "\n").alias("head"), number("file").alias("files"), number("insertion").alias("insertions"), number("deletion").alias("deletions"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, strftime(ts - interval 7 day, '%Y-%m-%dT%H:%M:%S.%f') as week_before from events")
def iso_times(spark, sf):
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return table(spark, sf, "events").select("event_id", F.date_format("ts", form).alias("iso"), F.date_format(F.expr("ts - interval 7 days"), form).alias("week_before"))


RAW_TIME = "case event_id % 6 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') when 2 then strftime(ts, '%Y-%m-%d') when 3 then 'yesterday' when 4 then '' end"


@query(f"select event_id, strftime(coalesce(try_cast(raw as timestamptz), timestamptz '2024-06-01 00:00:00+00'), '%Y-%m-%d %H:%M:%S') as at from (select event_id, {RAW_TIME} as raw from events)")
def tolerant_times(spark, sf):
    """Times from text: without an offset they are UTC; what cannot be read, and nothing, is the run's own time."""
    form = lambda f: F.date_format("ts", f)
    raw = F.when(F.col("event_id") % 6 == 0, form("yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 6 == 1, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(F.col("event_id") % 6 == 2, form("yyyy-MM-dd")).when(F.col("event_id") % 6 == 3, "yesterday").when(F.col("event_id") % 6 == 4, "")
    at = F.coalesce(F.try_to_timestamp(raw), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


LIMIT = "case c_custkey % 6 when 0 then ' 7 ' when 1 then '3' when 2 then 'many' when 3 then '' when 4 then '2.5' end"


@query(f"""select c_custkey as story_id, coalesce(n, 0) as cycles, coalesce(case when regexp_full_match(trim({LIMIT}), '-?[0-9]+') then cast(trim({LIMIT}) as int) end, 5) as most, coalesce(n, 0) >= coalesce(case when regexp_full_match(trim({LIMIT}), '-?[0-9]+') then cast(trim({LIMIT}) as int) end, 5) as over
  from customer left join (select o_custkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_linestatus = 'F' group by 1) on o_custkey = c_custkey""")
def rework_cycles(spark, sf):
    """How often each story went back, against a limit from a setting's text; garbage and nothing mean 5."""
    back = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    counts = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(back, "o_orderkey").groupBy("c_custkey").agg(F.sum("k").alias("n"))
    rows = table(spark, sf, "customer").join(counts, "c_custkey", "left").withColumn("cycles", F.coalesce("n", F.lit(0))).withColumn("most", F.coalesce(F.trim(F.expr(LIMIT)).try_cast("int"), F.lit(5)))
    return rows.select(F.col("c_custkey").alias("story_id"), "cycles", "most", (F.col("cycles") >= F.col("most")).alias("over"))


#: Names of an older system and what they are here.
REMAP = {"view": "seen", "click": "used", "purchase": "done", "signup": "joined"}


@query("select event_id, coalesce(m.new, 'other') as kind, cast(least(5, 1 + length(event_type)) as int) as depth, row_number() over (partition by user_id order by ts, event_id) as attempt from events left join (values ('view', 'seen'), ('click', 'used'), ('purchase', 'done'), ('signup', 'joined')) m(old, new) on old = event_type")
def legacy_events(spark, sf):
    """Rows of an older system: names by a map, depths clamped, attempts by a running count for each parent."""
    from pyspark.sql import Window

    names = F.create_map(*(F.lit(x) for pair in REMAP.items() for x in pair))
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf, "events").select("event_id", F.coalesce(names[F.col("event_type")], F.lit("other")).alias("kind"), F.least(F.lit(5), F.length("event_type") + 1).alias("depth"), attempt.alias("attempt"))


@query("select task_id, concat('open: ', string_agg(concat('- ', kind, '#', cast(position as varchar), ': ', text, ' (', status, ')'), chr(10) order by kind, position, text, status)) as block, count(*) as n from item where status in ('todo', 'in_progress') group by 1", ("item",))
def retry_blocks(spark, sf):
    """What a denied run left open, as a block of text for the next one."""
    line = F.concat(F.lit("- "), "kind", F.lit("#"), F.col("position").cast("string"), F.lit(": "), "text", F.lit(" ("), "status", F.lit(")"))
    rows = table(spark, sf, "item").filter("status in ('todo', 'in_progress')").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("kind", "position", "text", "status", line.alias("line")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("task_id", F.concat(F.lit("open: "), F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("block"), "n")


@query("""with line as (select l_orderkey as task_id, max(case when p_size > 45 then 1 else 0 end) as spaced, count(*) as n, count(distinct l_partkey) as parts, count(distinct l_partkey) filter (where l_returnflag = 'A') as bare from lineitem join part on p_partkey = l_partkey group by 1)
  select task_id, concat_ws(',', case when spaced = 1 then 'tools' end, case when bare > 0 then 'servers' end, case when n > 8 then 'skills' end) as errors from line""")
def runner_field_errors(spark, sf):
    """Fields of a runner, made from a task's lines, and what is wrong with them."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = table(spark, sf, "lineitem").join(part, "l_partkey")
    tool = F.when(F.col("p_size") > 45, F.concat("p_brand", F.lit(" x"))).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    # a server is one part's; it has no address if any of the part's lines has none
    server = rows.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("bare")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_partkey").cast("string"), F.struct(F.when(~F.col("bare") & (F.col("l_partkey") % 2 == 0), "http://x").alias("url"), F.when(~F.col("bare") & (F.col("l_partkey") % 2 == 1), "run").alias("command"))))).alias("servers"))
    lists = rows.groupBy("l_orderkey").agg(F.collect_list(tool).alias("tools"), F.collect_list(F.concat(F.lit("skill"), F.col("l_linenumber").cast("string"))).alias("skills"))
    return lists.join(server, "l_orderkey").select(F.col("l_orderkey").alias("task_id"), F.array_join(L.runner_errors(F.col("tools"), F.col("servers"), F.col("skills")), ",").alias("errors"))


@query("select l_orderkey as task_id, count(*) filter (where not (case when l_linenumber % 3 = 0 then l_suppkey % 4 = 1 else l_partkey % 4 = 1 end)) as foreign_lines from lineitem group by 1")
def tracked_changes(spark, sf):
    """Lines of short status output whose path, after a rename if there is one, is under no kept folder."""
    path = lambda c: F.concat(F.element_at(F.array(*map(F.lit, ("src/", "docs/", "lib/", "x docs/"))), (F.col(c) % 4 + 1).cast("int")), F.col(c).cast("string"))
    line = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("R  "), path("l_partkey"), F.lit(" -> "), path("l_suppkey"))).otherwise(F.concat(F.lit(" M "), path("l_partkey")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count_if(~L.kept_path(line, ("docs/", "tests/"))).alias("foreign_lines"))


@query("""with a as (select l_orderkey, l_partkey % 5 as x from lineitem where l_linenumber <= 4 group by 1, 2), b as (select l_orderkey, l_suppkey % 5 as x from lineitem where l_linenumber >= 3 group by 1, 2), k as (select l_orderkey from a union select l_orderkey from b)
  select l_orderkey as task_id, exists (select 1 from a join b using (l_orderkey, x) where a.l_orderkey = k.l_orderkey) as touches, (select count(*) from a where a.l_orderkey = k.l_orderkey and x not in (select x from b where b.l_orderkey = k.l_orderkey)) as gone,
  (select count(*) from b where b.l_orderkey = k.l_orderkey and x not in (select x from a where a.l_orderkey = k.l_orderkey)) as added from k""")
def set_changes(spark, sf):
    """Two sets by task: whether they meet, what the first has alone, and what the second has."""
    of = lambda which, c: F.coalesce(F.collect_set(F.when(which, F.col(c) % 5)), F.array().cast("array<bigint>"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(of(F.col("l_linenumber") <= 4, "l_partkey").alias("a"), of(F.col("l_linenumber") >= 3, "l_suppkey").alias("b"))
    return rows.select("task_id", F.arrays_overlap("a", "b").alias("touches"), F.size(F.array_except("a", "b")).cast("long").alias("gone"), F.size(F.array_except("b", "a")).cast("long").alias("added"))


@query("select user_id, arg_max(value, event_id) as value, count(*) - 1 as dropped from events where event_type <> 'error' group by 1")
def latest_requests(spark, sf):
    """Of the answers to a user's requests the one to the newest request stays."""
    return table(spark, sf, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("""select doc_id, 'strict' as parsed, ['success', 'failed', 'blocked'][cast(doc_id % 3 as int) + 1] as status, coalesce(text, '') as summary, case when doc_id % 2 = 0 then lang end as target, case when doc_id % 2 = 0 then source end as reason,
  case when doc_id % 4 < 3 then concat('developer#', n_chars, '#done') else '' end as updates, case when doc_id % 5 = 0 then concat('A-', doc_id, ':blocked_by') else '' end as relations, concat('why ', lang) as questions, coalesce(text, '') as artifact_md, source as comments from documents where trim(source) <> ''""")
def report_text_fields(spark, sf):
    """The fields of a report that stands behind a whole text of prose and has the text in it: what was written is read."""
    some = lambda which, value: F.expr(f"if({which}, {value}, null)")
    raw = F.to_json(
        F.struct(
            F.element_at(F.array(*map(F.lit, ("success", "failed", "blocked"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"), F.coalesce("text", F.lit("")).alias("summary_md"), F.expr("if(doc_id % 2 = 0, named_struct('to', lang, 'reason', source), null)").alias("proposed_transition"),
            F.expr("array(named_struct('checklist_kind', if(doc_id % 4 < 3, 'developer', 'other'), 'item_position', n_chars, 'new_status', 'done'))").alias("checklist_updates"), F.expr("array(named_struct('task_code', concat('A-', doc_id), 'kind', if(doc_id % 5 = 0, 'blocked_by', 'odd')))").alias("relations_updates"),
            F.array(F.concat(F.lit("why "), "lang")).alias("questions"), F.lit("qa_report").alias("artifact_kind"), F.coalesce("text", F.lit("")).alias("artifact_md"), some("true", "source").alias("comments"),
        )
    )
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(' {prose {"status": "odd"} '), raw, F.lit(" tail } {"))
    rows = reports.parsed(table(spark, sf, "documents").filter("trim(source) <> ''").select("doc_id", said.alias("said")), "doc_id", "said")
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return rows.select("doc_id", "parsed", "status", "summary", "target", "reason", joined("updates", lambda u: F.concat_ws("#", u["kind"], u["position"].cast("string"), u["status"])).alias("updates"), joined("relations", lambda r: F.concat_ws(":", r["code"], r["kind"])).alias("relations"), F.array_join("questions", ",").alias("questions"), "artifact_md", F.array_join("comments", ",").alias("comments"))


@query("""select doc_id, 'lenient' as parsed, ['success', 'failed', 'blocked'][cast(doc_id % 3 as int) + 1] as status, coalesce(lang, 'none') as target, coalesce(source, '') as reason, concat('psi#', n_chars, '#closed#', coalesce(source, '')) as updates,
  case when doc_id % 2 = 0 then replace(coalesce(text, ''), concat(chr(13), chr(10)), chr(10)) end as artifact_md, coalesce(source, '') as comments from documents where trim(source) <> ''""")
def report_broken_fields(spark, sf):
    """The fields of a report that no JSON reader takes, for a raw line break in it; it stands behind a whole text and has it in it."""
    json_text = lambda c: F.expr(f"substring(to_json(named_struct('t', coalesce({c}, ''))), 6, length(to_json(named_struct('t', coalesce({c}, '')))) - 6)")
    said = F.concat(
        F.coalesce("text", F.lit("")), F.lit(' {"status": "'), F.element_at(F.array(*map(F.lit, ("success", "failed", "blocked"))), (F.col("doc_id") % 3 + 1).cast("int")), F.lit('", "note": "raw\nbreak", "proposed_transition": {"to": "'), F.coalesce("lang", F.lit("none")), F.lit('", "reason": '), json_text("source"),
        F.lit('}, "checklist_updates": [{"checklist_kind": "psi", "item_position": '), F.col("n_chars").cast("string"), F.lit(', "new_status": "closed", "text": '), json_text("source"), F.lit('}], "artifact_kind": "'), F.when(F.col("doc_id") % 2 == 0, "qa_report").otherwise("other"), F.lit('", "artifact_md": '), json_text("text"),
        F.lit(', "comments": ["", '), json_text("source"), F.lit("]}"),
    )
    rows = reports.parsed(table(spark, sf, "documents").filter("trim(source) <> ''").select("doc_id", said.alias("said")), "doc_id", "said")
    updates = F.array_join(F.transform("updates", lambda u: F.concat_ws("#", u["kind"], u["position"].cast("string"), u["status"], u["text"])), ",")
    return rows.select("doc_id", "parsed", "status", "target", "reason", updates.alias("updates"), "artifact_md", F.array_join("comments", ",").alias("comments"))
