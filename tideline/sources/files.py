"""Files as tables: Markdown registries, JSON, flows in YAML, SQLite snapshots; and dumps of all tables."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_registry(spark: SparkSession, root: str) -> DataFrame:
    """kind, name, rel_path, description, content_hash, size_bytes of commands/*.md and skills/*/SKILL.md under root.

    The description is the front matter's, else the first heading, at most 200 characters; empty if there is neither.
    Files without any bytes have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    text = F.col("content").cast("string")
    command, skill = F.regexp_extract("path", r"commands/([^/]+)\.md$", 1), F.regexp_extract("path", r"skills/([^/]+)/SKILL\.md$", 1)
    front = F.regexp_extract(text, r"(?ms)\A---\n.*?^description:[ \t]*([^\n]*).*?^---", 1)
    described = F.when(front != "", F.regexp_replace(front, r"""^["']|["']$""", "")).otherwise(F.regexp_extract(text, r"(?m)^# +([^\n]*)", 1))
    rows = files.select(F.when(command != "", "command").when(skill != "", "skill").alias("kind"), F.when(command != "", command).otherwise(skill).alias("name"), F.regexp_extract("path", r"((?:commands|skills)/.*)$", 1).alias("rel_path"), F.left(F.trim(described), F.lit(200)).alias("description"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"))
    return rows.filter("kind is not null")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file or array element; broken files give a row of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def flow(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Statuses in order and transitions of a flow written as YAML or JSON. JSON needs no further library."""
    import json

    try:
        found = json.loads(text)
    except ValueError:
        import yaml  # only for YAML text

        found = yaml.safe_load(text)
    statuses = [(s["key"], i, bool(s.get("entry")), bool(s.get("terminal")), bool(s.get("blocking")), s.get("checklist_gate"), s.get("kind"), list(s.get("behaviors") or [])) for i, s in enumerate(found["statuses"])]
    edges = [(t["from"], t["to"], t.get("runner"), t.get("rule"), list(t.get("when") or [])) for t in found["transitions"]]
    return (
        spark.createDataFrame(statuses, "status_key string, position int, is_entry boolean, is_terminal boolean, is_blocking boolean, checklist_gate string, kind string, behaviors array<string>"),
        spark.createDataFrame(edges, "from_status string, to_status string, runner string, rule_code string, when array<string>"),
    )


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a legacy snapshot, which is one local file on the driver; where a JDBC driver is at hand, spark.read.jdbc reads it in parts."""
    if not name.isidentifier():
        raise ValueError(f"not a table name: {name}")
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        rows = con.execute(f"select {', '.join(x.strip().split()[0] for x in schema.split(','))} from {name}").fetchall()
    return spark.createDataFrame(rows, schema)


def table_sizes(spark: SparkSession, database: str = "default") -> DataFrame:
    """Every table of a database with its number of rows."""
    counts = [spark.table(f"{database}.{t.name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("name"), "n") for t in spark.catalog.listTables(database) if not t.isTemporary]
    out = spark.createDataFrame([], "name string, n long")
    for one in counts:
        out = out.unionByName(one)
    return out
