"""Versioned documents: numbering, sections, carry-forward, acceptance runs, coverage, versions by content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.adapter import table
from .catalog import query


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def last_n_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    """The last three entries of each parent."""
    return R.first_per(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


#: Ids of one range, within which rows of a key are numbered.
RANGE = 1 << 16

NUMBERS_SQL = """select conv_id, turn, role, case when role <> 'system' then cast(sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) end as number,
  last_value(case when role = 'system' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as section from conversations"""


def numbered(rows: DataFrame) -> DataFrame:
    """Items numbered within their document, headings not; and the last heading above each row."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    item = F.col("role") != "system"
    return rows.withColumn("number", F.when(item, F.sum(item.cast("long")).over(w))).withColumn("section", F.last(F.when(~item, F.col("turn")), ignorenulls=True).over(w))


@query(NUMBERS_SQL)
def doc_numbering(spark, sf):
    return numbered(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "number", "section")


@query("""with old as (select conv_id, turn, role, case when role <> 'system' and turn % 4 < 3 then conv_id * 10 + turn end as linked, text from conversations),
  payload as (select conv_id, turn, case when conv_id % 3 = 0 then -turn when turn % 3 = 1 then conv_id * 10 + turn end as linked, upper(role) as role from conversations where turn % 3 = 1 and role <> 'system'),
  mode as (select conv_id, count(*) > 0 as delta from old where linked is not null and exists (select 1 from payload p where p.conv_id = old.conv_id and p.linked = old.linked) group by 1),
  touched as (select conv_id from payload group by 1),
  kept as (select old.* from old join mode using (conv_id) where delta and not exists (select 1 from payload p where p.conv_id = old.conv_id and p.linked = old.linked)),
  whole as (select conv_id, 0 as part, turn, case when role = 'system' then 'heading' else 'item' end as kind, role as text, linked, case when role <> 'system' then 6 end as carried_from from kept
    union all select conv_id, 1, -1, 'heading', 'section', null, null from touched union all select conv_id, 2, turn, 'item', role, linked, null from payload)
  select conv_id, row_number() over (partition by conv_id order by part, turn) - 1 as position, kind, text, case when kind = 'item' then 'todo' end as status, linked, carried_from from whole""")
def carry_forward_merge(spark, sf):
    """A new version of each document that is registered anew.

    If its payload touches a task that an old item is linked to, the old rows not so linked are carried over, marked with
    the version they come from, with no verdict; then the payload's sections follow. If it touches none, the payload is the
    whole document. Positions start at 0.
    """
    rows = table(spark, sf, "conversations")
    code = F.col("conv_id") * 10 + F.col("turn")
    old = rows.select("conv_id", "turn", "role", F.when((F.col("role") != "system") & (F.col("turn") % 4 < 3), code).alias("linked"))
    payload = rows.filter("turn % 3 = 1 and role <> 'system'").select("conv_id", "turn", F.upper("role").alias("text"), F.when(F.col("conv_id") % 3 == 0, -F.col("turn")).otherwise(code).alias("linked"))
    return carried(old, payload, 6)


def carried(old: DataFrame, payload: DataFrame, version: int) -> DataFrame:
    """The rows of new versions from old ones (conv_id, turn, role, linked) and payloads (conv_id, turn, text, linked)."""
    hit = old.filter("linked is not null").join(payload.select("conv_id", "linked").distinct(), ["conv_id", "linked"], "left_semi")
    delta = hit.select("conv_id").distinct()
    kept = old.join(delta, "conv_id", "left_semi").join(payload.select("conv_id", "linked").distinct(), ["conv_id", "linked"], "left_anti")
    heading = F.col("role") == "system"
    parts = [
        kept.select("conv_id", F.lit(0).alias("part"), "turn", F.when(heading, "heading").otherwise("item").alias("kind"), F.col("role").alias("text"), "linked", F.when(~heading, F.lit(version)).alias("carried_from")),
        payload.select("conv_id").distinct().select("conv_id", F.lit(1), F.lit(-1).cast("long"), F.lit("heading"), F.lit("section"), F.lit(None).cast("long"), F.lit(None).cast("int")),
        payload.select("conv_id", F.lit(2), "turn", F.lit("item"), "text", "linked", F.lit(None).cast("int")),
    ]
    w = Window.partitionBy("conv_id").orderBy("part", "turn")
    return reduce(DataFrame.union, parts).select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("position"), "kind", "text", F.when(F.col("kind") == "item", "todo").alias("status"), "linked", "carried_from")


@query("""with n as (select conv_id, turn, cast(sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as number, role from conversations),
  r as (select n.conv_id, number, coalesce(quality, 1) = 1 as passed, number % 4 = 0 as has_bug from n left join labels on doc_id = n.conv_id * 3 + n.turn where role <> 'system')
  select conv_id, count(*) as items, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, count(*) filter (where not passed and not has_bug) as proposals, count(*) filter (where not passed) > 0 and bool_and(passed or has_bug) as all_linked from r group by 1""")
def acceptance_run_snapshot(spark, sf):
    """An acceptance run by document: counts, proposals for failed items without a bug, and whether every failure has one."""
    items = numbered(table(spark, sf, "conversations")).filter("role <> 'system'").withColumn("doc_id", F.col("conv_id") * 3 + F.col("turn"))
    passed, bug = F.coalesce("quality", F.lit(1)) == 1, F.col("number") % 4 == 0
    rows = items.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("conv_id", passed.alias("ok"), bug.alias("bug"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & ~F.col("bug")).alias("proposals"), ((F.count_if(~F.col("ok")) > 0) & F.bool_and(F.col("ok") | F.col("bug"))).alias("all_linked"))


@query("""select c_custkey as story_id, count(o_orderkey) as changed, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) filter (where o_orderkey % 3 > 0), '') as affected,
  coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) filter (where o_orderkey % 3 = 0), '') as not_covered from customer left join orders on o_custkey = c_custkey and o_orderdate > timestamp '1998-01-01' group by 1""")
def coverage_delta(spark, sf):
    """Children changed since the last document: those that its items cover, and those that none does."""
    changed = table(spark, sf, "orders").filter(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("story_id"), "o_orderkey", (F.col("o_orderkey") % 3 > 0).alias("covered"))
    listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.col("o_orderkey")))), lambda x: x.cast("string")), ",")
    lists = changed.groupBy("story_id").agg(F.count(F.lit(1)).alias("changed"), listed(F.col("covered")).alias("affected"), listed(~F.col("covered")).alias("not_covered"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("story_id")).join(lists, "story_id", "left").fillna(0, ["changed"]).fillna("", ["affected", "not_covered"])


@query("""select user_id, count(*) as events, 1 + count(*) filter (where prior is not null and prior <> mark) as version from (select *, lag(mark) over (partition by user_id order by ts, event_id) as prior from (select *, sha256(coalesce(event_type, '')) as mark from events)) group by 1""")
def reference_versions(spark, sf):
    """A version goes up whenever the content's digest changes."""
    rows = table(spark, sf, "events").withColumn("mark", F.sha2(F.coalesce("event_type", F.lit("")), 256))
    rows = rows.withColumn("prior", F.lag("mark").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), (F.count_if(F.col("prior") != F.col("mark")) + 1).alias("version"))


@query("""select doc_id, change from (select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.mark <> b.mark then 'updated' else 'same' end as change
  from (select doc_id, sha256(text) as mark from documents where doc_id % 7 > 0) a full join (select doc_id, sha256(case when doc_id % 5 = 0 then concat(text, '!') else text end) as mark from documents where doc_id % 11 > 0) b on a.doc_id = b.doc_id)""")
def registry_diff(spark, sf):
    """A registry against what is on disk, by digest; texts are digested before the join, so only digests move."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    before = docs.filter("doc_id % 7 > 0").select("doc_id", F.sha2("text", 256).alias("mark"))
    after = docs.filter("doc_id % 11 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("mark"))
    return R.diff(before, after, "doc_id", "mark")


@query("""select source, doc_id, cast(used as bigint) as used, kept from (select source, doc_id, coalesce(sum(least(length(text), 400)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as used, least(length(text), 400) as size from documents)
  cross join lateral (select cast(greatest(0, least(size, 7000 - used)) as bigint) as kept) where kept > 0""")
def budgeted_context(spark, sf):
    """Texts, cut to a chunk each, until a source's budget is used up.

    A source may hold a large share of all texts: sizes are added up by ever smaller ranges of ids, of which only those that
    begin within the budget are looked into, so no task adds up more than a few thousand sums and one range of rows.
    """
    budget = 7000
    rows = table(spark, sf, "documents").select("source", "doc_id", F.least(F.length("text"), F.lit(400)).alias("size"))
    base, keys = F.lit(0).cast("long"), ["source"]
    for k, span in enumerate((10**9, 10**6, 10**3)):
        rows = rows.withColumn(f"part{k}", F.floor(F.col("doc_id") / span))
        sums = rows.withColumn("base", base).groupBy(*keys, f"part{k}", "base").agg(F.sum("size").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy(*keys).orderBy(f"part{k}").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("base", F.col("base") + F.coalesce(before, F.lit(0))).filter(F.col("base") < budget).drop("sum")
        keys = [*keys, f"part{k}"]
        rows, base = rows.drop("base").join(sums, keys), F.col("base")
    own = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", F.col("base") + own)
    return rows.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("used"))).cast("long")).filter("kept > 0").select("source", "doc_id", "used", "kept")


@query("""select conv_id, string_agg(case when role = 'system' then concat('## ', text) else concat(cast(number as varchar), '. ', text) end, chr(10) order by turn) as body
  from (select *, sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id order by turn) as number from conversations) group by 1""")
def document_render(spark, sf):
    """A document as text: headings, and items with their numbers."""
    line = F.when(F.col("role") == "system", F.concat(F.lit("## "), "text")).otherwise(F.concat(F.col("number").cast("string"), F.lit(". "), "text"))
    rows = numbered(table(spark, sf, "conversations")).select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))


@query("select c_mktsegment as kind, c_custkey as doc_id, 10 + row_number() over (partition by c_mktsegment order by c_custkey) as version from customer")
def versioned_append(spark, sf):
    """New rows get the versions after the highest known of their key."""
    customers = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("doc_id"))
    known = customers.select("kind").distinct().withColumn("version", F.lit(10).cast("long"))
    return R.next_versions(known, customers, ["kind"], [F.col("doc_id")], coarse=[F.floor(F.col("doc_id") / RANGE)]).select("kind", "doc_id", F.col("version").cast("long"))


@query("select o_orderkey as task_id, concat('N', cast(o_custkey % 25 as varchar), '-', cast(1000 + row_number() over (partition by o_custkey % 25 order by o_orderkey) as varchar)) as code from orders")
def task_code_numbering(spark, sf):
    """Codes that go on from a project's counter and are never used again."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 25).alias("project"))
    rows = R.numbered(rows, ["project"], [F.floor(F.col("task_id") / RANGE)], [F.col("task_id")])
    return rows.select("task_id", F.concat(F.lit("N"), F.col("project").cast("string"), F.lit("-"), (1000 + F.col("number")).cast("string")).alias("code"))
