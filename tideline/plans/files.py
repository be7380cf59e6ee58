"""File sources and sinks, made from tables and read back: what was written is what is there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sinks
from ..session import new_path
from ..sources import files
from ..sources.adapter import table
from .catalog import query


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the file system that Spark uses for the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


TEXT = "concat('---', chr(10), 'name: ', lower(r_name), chr(10), 'description: About ', r_name, chr(10), '---', chr(10), '# ', r_name, chr(10))"


@query(f"""select 'command' as kind, lower(r_name) as name, concat('commands/', lower(r_name), '.md') as rel_path, concat('About ', r_name) as description, sha256({TEXT}) as content_hash, cast(length({TEXT}) as bigint) as size_bytes from region
  union all select 'skill', concat('s', cast(r_regionkey as varchar)), concat('skills/s', cast(r_regionkey as varchar), '/SKILL.md'), concat('Skill ', r_name), sha256(concat('text', chr(10), '# Skill ', r_name, chr(10))), cast(length(concat('text', chr(10), '# Skill ', r_name, chr(10))) as bigint) from region""")
def registry_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of Markdown files as a registry: kind, name, description, digest and size."""
    root = new_path(spark, "registry")
    for r in table(spark, sf, "region").collect():  # five rows, one file each
        put(spark, f"{root}/commands/{r.r_name.lower()}.md", f"---\nname: {r.r_name.lower()}\ndescription: About {r.r_name}\n---\n# {r.r_name}\n")
        put(spark, f"{root}/skills/s{r.r_regionkey}/SKILL.md", f"text\n# Skill {r.r_name}\n")
        put(spark, f"{root}/skills/s{r.r_regionkey}/notes.md", "# no")
    return files.markdown_registry(spark, root).select("kind", "name", "rel_path", "description", "content_hash", F.col("size_bytes").cast("long").alias("size_bytes"))


@query("select r_regionkey as port, r_name as name from region where r_regionkey <> 3 union all select null, null")
def manifest_files(spark, sf):
    """JSON files, one of them broken: that one gives a row of nulls."""
    root = new_path(spark, "manifest")
    for r in table(spark, sf, "region").collect():  # five rows
        put(spark, f"{root}/{r.r_regionkey}.json", json.dumps({"port": r.r_regionkey, "name": r.r_name, "more": [1]}, indent=1) if r.r_regionkey != 3 else '{"port": 3, ')
    return files.json_documents(spark, root, "port int, name string")


@query("select status_key, position, is_entry, is_terminal, gate as checklist_gate, behaviors, coalesce(n, 0) as edges from flow_status s left join (select version_id, current as status_key, count(*) as n from flow_transition group by 1, 2) using (version_id, status_key) where version_id = 'story-2'", ("flow_version", "flow_status", "flow_transition"))
def preset_flow(spark, sf):
    """A flow exported as text and read again: statuses in order, and how many edges leave each."""
    one = lambda name: table(spark, sf, name).filter("version_id = 'story-2'").collect()  # noqa: E731  a flow's rows: dozens
    statuses = [{"key": s.status_key, "entry": s.is_entry, "terminal": s.is_terminal, "checklist_gate": s.gate, "behaviors": [b for b in s.behaviors.split(",") if b]} for s in sorted(one("flow_status"), key=lambda s: s.position)]
    text = json.dumps({"statuses": statuses, "transitions": [{"from": e.current, "to": e.target, "runner": e.runner} for e in one("flow_transition")]})
    nodes, edges = files.flow(spark, text)
    counts = edges.groupBy(F.col("from_status").alias("status_key")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(counts, "status_key", "left").select("status_key", "position", "is_entry", "is_terminal", "checklist_gate", F.array_join("behaviors", ",").alias("behaviors"), F.coalesce("edges", F.lit(0)).alias("edges"))


@query("select conv_id, string_agg(concat(role, ' ', replace(text, chr(10), ' ')), chr(10) order by turn) as body from conversations group by 1")
def document_files(spark, sf):
    """Documents written as text, a folder each, and read again line by line."""
    root = new_path(spark, "documents")
    line = F.concat("role", F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))
    sinks.documents_as_text(table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line")), root, "conv_id", "turn", "line")
    lines = spark.read.text(root).select(F.col("conv_id").cast("long").alias("conv_id"), "value", F.monotonically_increasing_id().alias("at"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("body"))


@query("select 'nation' as name, count(*) as n from nation union all select 'region', count(*) from region union all select 'orders', count(*) from orders")
def snapshot_counts(spark, sf):
    """A snapshot of tables, one of them partitioned, counted where it was written."""
    root, names = new_path(spark, "snapshot"), ("nation", "region", "orders")
    sinks.snapshot({n: table(spark, sf, n) for n in names}, root, {"orders": ["o_orderstatus"]})
    counts = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


CONFIG_SQL = """select s_nationkey as connection, concat('[', string_agg(concat('{"s_suppkey":', cast(s_suppkey as varchar), ',"s_name":"', NAME, '"}'), ',' order by s_suppkey), ']') as text from supplier group by 1"""


@query(f"with a as ({CONFIG_SQL.replace('NAME', 's_name')}), b as ({CONFIG_SQL.replace('NAME', 'case when s_nationkey % 3 = 0 then lower(s_name) else s_name end')}) select connection, b.text, sha256(b.text) as digest, cast(case when a.text = b.text then 1 else 2 end as integer) as written from a join b using (connection)")
def settings_written(spark, sf):
    """A configuration text for each connection, written only where its digest is a new one: after no change, and after one of some."""
    root, rows = new_path(spark, "settings"), table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    texts = lambda df: df.groupBy(F.col("s_nationkey").alias("connection")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))).alias("text"))
    for version in (rows, rows, rows.withColumn("s_name", F.when(F.col("s_nationkey") % 3 == 0, F.lower("s_name")).otherwise(F.col("s_name")))):
        sinks.changed_texts(texts(version), root, "connection")
    return sinks.texts_of(spark, root, "connection", "int")


@query("""select event_id, concat('event: ', event_type, chr(10), 'data: {"event_id":', cast(event_id as varchar), ',"user_id":', cast(user_id as varchar), '}', chr(10), chr(10)) as value from events where event_type = 'purchase'""")
def event_texts(spark, sf):
    """Rows as the text of server-sent events."""
    rows = table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", "user_id")
    text = sinks.server_events(rows, "purchase")
    return text.select(F.regexp_extract("value", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"), "value")


@query("select o_orderkey as event_id, case when o_custkey % 4 > 0 and o_orderdate > timestamp '1996-01-01' then o_custkey end as payload_id from orders")
def purged_references(spark, sf):
    """Payloads that have run out are gone, and events that refer to them, or to none that exists, refer to nothing."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("payload_id"), "o_custkey", "o_orderdate")
    payloads = orders.filter("o_custkey % 4 > 0").select("payload_id", F.col("o_orderdate").alias("expires_at"))
    _, kept = sinks.purged(orders, payloads, F.lit("1996-01-01").cast("timestamp_ntz"))
    return kept.select("event_id", F.when(F.col("payload_id").isNotNull(), F.col("o_custkey")).alias("payload_id"))
