"""Text and JSON processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reports
from ..sources.adapter import table
from .catalog import query


@query("select doc_id, case when length(text) <= 4000 then text else concat(left(text, 1200), '\n[...]\n', right(text, 2800)) end as short from documents")
def text_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.squeeze(F.col("text"), 4000, 1200, "\n[...]\n").alias("short"))


@query("select doc_id, case when length(text) <= 500 then text else concat('…', right(text, 499)) end as reason from documents")
def reason_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tail(F.col("text"), 500).alias("reason"))


@query("select doc_id, left(split_part(trim(replace(text, chr(10), concat(chr(10), chr(10)))), concat(chr(10), chr(10)), 1), 300) as paragraph from documents")
def first_paragraph(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_paragraph(F.replace("text", F.lit("\n"), F.lit("\n\n")), 300).alias("paragraph"))


@query("select orders.o_orderkey as task_id, array_to_string(list_distinct_in_order, ',') as codes from orders cross join lateral (select ['AB-' || o_orderkey, 'CD2-' || o_custkey] as list_distinct_in_order)")
def code_extraction(spark, sf):
    """Codes in a text, each once, in order."""
    said = F.format_string("see AB-%d, x-1 and CD2-%d (also AB-%d)", "o_orderkey", "o_custkey", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.array_join(X.codes(said), ",").alias("codes"))


LINES_SQL = "select doc_id, pos, line from (select doc_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from (select doc_id, concat(case doc_id % 7 when 0 then '- ' when 1 then '~ ' when 2 then 'x ' when 3 then '+ ' when 4 then '! ' when 5 then '## ' else '' end, replace(text, chr(10), concat(chr(10), case doc_id % 3 when 0 then 'x ' when 1 then '# ' else '' end))) as body from documents))"


CHECKLIST_SQL = rf"""select doc_id, cast(pos as int) as position, case when heading then 'heading' else 'item' end as kind, case when heading then cast(length(regexp_extract(l, '^(#{{1,5}})\s+(.*)$', 1)) as int) end as level,
  case when heading then regexp_extract(l, '^(#{{1,5}})\s+(.*)$', 2) when item then regexp_extract(l, '^([~+x!\-])\s+(.*)$', 2) else l end as text,
  case when heading then null when not item then 'todo' else case left(l, 1) when '~' then 'in_progress' when 'x' then 'closed' when '+' then 'done' when '!' then 'failed' else 'todo' end end as status
  from (select *, regexp_matches(l, '^(#{{1,5}})\s+(.*)$') as heading, regexp_matches(l, '^([~+x!\-])\s+(.*)$') as item from (select doc_id, pos, trim(line) as l from ({LINES_SQL})) where l <> '')"""


def checklist_rows(docs: DataFrame, said: Column) -> DataFrame:
    """Checklist text as rows: headings with levels, items with a status by their mark."""
    mark = F.expr("case doc_id % 7 when 0 then '- ' when 1 then '~ ' when 2 then 'x ' when 3 then '+ ' when 4 then '! ' when 5 then '## ' else '' end")
    more = F.expr("case doc_id % 3 when 0 then 'x ' when 1 then '# ' else '' end")
    body = F.concat(mark, F.replace(said, F.lit("\n"), F.concat(F.lit("\n"), more)))
    lines = docs.select("doc_id", F.posexplode(F.split(body, "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.select("doc_id", (F.col("at") + 1).cast("int").alias("position"), X.checklist_line(F.col("line")).alias("x")).select("doc_id", "position", "x.*")


@query(CHECKLIST_SQL)
def checklist_parse(spark, sf):
    """Every line of each text."""
    return checklist_rows(table(spark, sf, "documents"), F.col("text"))


@query(r"select page_id, case when page_id % 2 = 0 then left(regexp_extract(concat('---', chr(10), 'name: x', chr(10), 'description: ', url, chr(10), '---', chr(10)), 'description:\s*([^\n]*)', 1), 200) else left(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 200) end as title from pages")
def front_matter_title(spark, sf):
    """A file's description from its front matter, else its first heading."""
    front = F.format_string("---\nname: x\ndescription: %s\n---\n", "url")
    title = F.when(F.col("page_id") % 2 == 0, F.regexp_extract(front, r"(?m)^description:\s*([^\n]*)", 1)).otherwise(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    return table(spark, sf, "pages").select("page_id", F.left(title, F.lit(200)).alias("title"))


@query("select o_orderkey as task_id, cast(i as int) as position, field, old, new from (select o_orderkey, unnest([1, 2]) as i, unnest(['status', 'total']) as field, unnest([o_orderstatus, cast(cast(floor(o_totalprice) as bigint) as varchar)]) as old, unnest(['F', cast(cast(floor(o_totalprice) as bigint) + 1 as varchar)]) as new from orders)")
def settings_diff_explode(spark, sf):
    """A journal's JSON difference as rows."""
    whole = F.floor("o_totalprice").cast("long")
    entry = lambda f, a, b: F.struct(F.lit(f).alias("field"), a.alias("old"), b.alias("new"))
    diff = F.to_json(F.array(entry("status", F.col("o_orderstatus"), F.lit("F")), entry("total", whole.cast("string"), (whole + 1).cast("string"))))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.posexplode(F.from_json(diff, "array<struct<field:string, old:string, new:string>>")).alias("at", "x"))
    return rows.select("task_id", (F.col("at") + 1).cast("int").alias("position"), "x.*")


@query("""select rule, n from (select 'mnemonic' as rule, count(*) filter (where not regexp_full_match(n_name, '[A-Z0-9]{2,10}')) as n from nation union all select 'priority', count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) from orders
  union all select 'title', count(*) filter (where length(trim(c_name)) not between 1 and 17) from customer union all select 'auto_needs_rule', count(*) filter (where not (event_type <> 'error' or value > 50)) from events union all select 'self_loop', count(*) filter (where l_orderkey = l_partkey) from lineitem)""")
def dq_violations(spark, sf):
    """How many rows break each rule; every table is read once."""
    rules = {
        "mnemonic": ("nation", ~F.col("n_name").rlike("^[A-Z0-9]{2,10}$")), "priority": ("orders", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")), "title": ("customer", ~F.length(F.trim("c_name")).between(1, 17)),
        "auto_needs_rule": ("events", ~((F.col("event_type") != "error") | (F.col("value") > 50))), "self_loop": ("lineitem", F.col("l_orderkey") == F.col("l_partkey")),
    }
    out = None
    for name, (source, broken) in rules.items():
        one = table(spark, sf, source).agg(F.count_if(broken).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select doc_id, source, case when doc_id % 4 = 0 then [1, 5, 15] when doc_id % 4 = 1 then [2, 4] when doc_id % 4 = 2 then [7] else [1, 5, 15] end[1] as first_pause, doc_id % 4 in (0, 3) as by_default from documents")
def pause_list(spark, sf):
    """Minutes from a setting's text; garbage and nothing mean the default."""
    raw = F.expr("case doc_id % 4 when 0 then '' when 1 then '2,0, 4' when 2 then '7,-1' else '3,x' end")
    got = X.pauses(raw, [1, 5, 15])
    return table(spark, sf, "documents").select("doc_id", "source", F.element_at(got, 1).alias("first_pause"), (F.size(got) == 3).alias("by_default"))


@query()
def report_parse_udf(spark, sf):
    """The last report in an agent's text, strictly, else leniently; the text has prose, braces and broken JSON around it."""
    text = F.expr("""concat(text, ' {not json} ', case doc_id % 4 when 0 then '{"status": "success", "summary_md": "ok", "proposed_transition": {"to": "in_review", "reason": "r"}, "comments": "one"} tail }'
        when 1 then '{"status": "failed", "checklist_updates": [{"checklist_kind": "developer", "item_position": 1, "new_status": "done"}, {"checklist_kind": "other"}]}'
        when 2 then '{"status": "blocked", "summary_md": "broken "quote", "artifact_kind": "qa_report", "artifact_md": "x"' else '{"status": "odd"}' end)""")
    return reports.parsed(table(spark, sf, "documents").select("doc_id", text.alias("said")), "doc_id", "said")


@query("select n_regionkey, count(*) as nations, (select count(*) from supplier where s_nationkey in (select n_nationkey from nation n where n.n_regionkey = nation.n_regionkey)) as suppliers from nation group by 1")
def ad_hoc_sql(spark, sf):
    """A read-only statement over named tables; its rows are capped where a person asks, not here."""
    return reports.read_only(spark, "select n_regionkey, count(distinct n_nationkey) as nations, count(s_suppkey) as suppliers from {nation} left join {supplier} on s_nationkey = n_nationkey group by 1", None, nation=table(spark, sf, "nation"), supplier=table(spark, sf, "supplier"))
