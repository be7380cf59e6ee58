"""Tables committed together, appended to and read back; the catalogue and audits of what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits
from ..session import new_path
from ..sources.adapter import table
from .catalog import query

#: String columns of the input tables, for the comparison only: the queries find them in the schemas.
TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
         "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}
NAMES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
#: What must not be stored as it is.
FORBIDDEN = "(?i)(password|secret|token|api_key)"


def catalogue(spark: SparkSession, sf: str) -> list[str]:
    """The tables of an input folder, by listing it."""
    return [n.removesuffix(".parquet") for n in commits.names_in(spark, sf) if n.endswith(".parquet")]


@query(" union all ".join(f"select '{n}' as name, (select count(*) from {n}) as n, (select count(*) from (describe {n})) as n_columns" for n in NAMES))
def catalogue_tables(spark, sf):
    """Every table that the folder has, with its rows and columns."""
    one = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n", F.lit(len(df.columns)).cast("long").alias("n_columns")) for n in catalogue(spark, sf) for df in [table(spark, sf, n)]]
    return reduce(DataFrame.unionByName, one)


@query(" union all ".join(f"select '{t}' as name, '{c}' as column_name, count({c}) as n, count(*) filter (where regexp_matches({c}, '{FORBIDDEN}')) as hits from {t}" for t, cs in TEXTS.items() for c in cs))
def stored_text_audit(spark, sf):
    """Stored texts in which a forbidden word stands, by table and column: one pass over each table."""
    out = []
    for name in catalogue(spark, sf):
        df = table(spark, sf, name)
        texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if texts:
            counts = [F.struct(F.lit(c).alias("column_name"), F.count(F.col(f"`{c}`")).alias("n"), F.count_if(F.col(f"`{c}`").rlike(FORBIDDEN)).alias("hits")) for c in texts]
            out.append(df.agg(F.array(*counts).alias("x")).select(F.lit(name).alias("name"), F.explode("x").alias("x")).select("name", "x.*"))
    return reduce(DataFrame.unionByName, out)


@query(" union all ".join(f"select '{n}' as name, (select count(*) from {n}) as n, true as sound" for n in NAMES))
def committed_snapshot(spark, sf):
    """A snapshot of every table as one version: rows by its manifest, and whether what is there is what was written."""
    root = new_path(spark, "snapshot")
    commits.commit(spark, root, {n: table(spark, sf, n) for n in catalogue(spark, sf)})
    bad, found = commits.broken(spark, root), commits.manifest(spark, root)["tables"]
    rows = [(name, sum(p["rows"] for p in t["parts"]), not any(p["folder"] in bad for p in t["parts"])) for name, t in found.items()]
    return spark.createDataFrame(rows, "name string, n long, sound boolean")


@query("""select conv_id, cast(count(*) filter (where turn <= 1) as integer) as after_failure, cast(count(*) filter (where turn <= 4) as integer) as at_end, sha256(string_agg(coalesce(text, ''), chr(10) order by turn) filter (where turn <= 4)) as body_sha256 from conversations group by 1""")
def committed_documents(spark, sf):
    """A document's version and its text are two tables and one commit: a failure before the manifest shows neither."""
    root, turns = new_path(spark, "versions"), table(spark, sf, "conversations")

    def version(last: int) -> dict[str, DataFrame]:
        rows = turns.filter(F.col("turn") <= last)
        order = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
        return {"versions": turns.groupBy("conv_id").agg(F.count_if(F.col("turn") <= last).cast("int").alias("n_items")), "bodies": rows.groupBy("conv_id").agg(F.array_join(order, "\n").alias("body"))}

    commits.commit(spark, root, version(1))
    commits.stage(spark, root, version(2))  # the writer stops here
    seen = commits.read(spark, root, "versions").select("conv_id", F.col("n_items").alias("after_failure"))
    commits.commit(spark, root, version(4))
    bodies = commits.read(spark, root, "bodies").select("conv_id", F.sha2("body", 256).alias("body_sha256"))
    return seen.join(commits.read(spark, root, "versions").select("conv_id", F.col("n_items").alias("at_end")), "conv_id").join(bodies, "conv_id", "left")


@query("select event_id, user_id, case when event_type = 'view' then 1 when event_type = 'click' then 2 else 3 end as version from events")
def appended_log(spark, sf):
    """A log that has rows is appended to, twice, and read back with the version that brought each row."""
    root, rows = new_path(spark, "log"), table(spark, sf, "events").select("event_id", "user_id", "event_type")
    commits.commit(spark, root, {"log": rows.filter("event_type = 'view'")})
    commits.append(spark, root, {"log": rows.filter("event_type = 'click'")})
    commits.append(spark, root, {"log": rows.filter("coalesce(event_type, '') not in ('view', 'click')")})
    return commits.read(spark, root, "log", added_in="version").select("event_id", "user_id", "version")
