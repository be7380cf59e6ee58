import datetime
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tideline.operators import relational as R
from tideline.operators import sinks
from tideline.sources import files


def test_markdown_registry_and_drift(spark, tmp_path):
    (tmp_path / "commands").mkdir()
    (tmp_path / "skills/one").mkdir(parents=True)
    (tmp_path / "commands/go.md").write_text("---\nname: go\ndescription: 'Goes on'\n---\n# Not this\n")
    (tmp_path / "skills/one/SKILL.md").write_text("text\n# First heading\n# Second\n")
    (tmp_path / "skills/one/other.md").write_text("# no")
    got = {(r.kind, r.name): r for r in files.markdown_registry(spark, str(tmp_path)).collect()}
    assert {k: r.description for k, r in got.items()} == {("command", "go"): "Goes on", ("skill", "one"): "First heading"}
    assert got["skill", "one"].content_hash == hashlib.sha256((tmp_path / "skills/one/SKILL.md").read_bytes()).hexdigest()
    before = spark.createDataFrame([(r.rel_path, r.content_hash) for r in got.values()], "rel_path string, content_hash string")
    (tmp_path / "commands/go.md").write_text("changed")
    (tmp_path / "commands/new.md").write_text("new")
    (tmp_path / "skills/one/SKILL.md").unlink()
    after = files.markdown_registry(spark, str(tmp_path))
    assert {tuple(r) for r in R.diff(before, after, "rel_path", "content_hash").collect()} == {("commands/go.md", "updated"), ("commands/new.md", "added"), ("skills/one/SKILL.md", "removed")}


def test_json_flow_and_sqlite(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"port": 1, "name": "x"}')
    (tmp_path / "b.json").write_text("{broken")
    assert {tuple(r) for r in files.json_documents(spark, str(tmp_path), "port int, name string").collect()} == {(1, "x"), (None, None)}
    statuses, edges = files.flow(spark, json.dumps({"statuses": [{"key": "a", "entry": True}, {"key": "b", "terminal": True, "behaviors": ["x"]}], "transitions": [{"from": "a", "to": "b", "when": ["p"]}]}))
    assert [tuple(r)[:4] for r in statuses.orderBy("position").collect()] == [("a", 0, True, False), ("b", 1, False, True)]
    assert edges.first().when == ["p"]
    with sqlite3.connect(tmp_path / "old.db") as con:
        con.execute("create table task(id integer, title text)")
        con.executemany("insert into task values (?, ?)", [(1, "x"), (2, None)])
    assert files.sqlite_table(spark, str(tmp_path / "old.db"), "task", "id long, title string").count() == 2
    with pytest.raises(ValueError):
        files.sqlite_table(spark, str(tmp_path / "old.db"), "task; drop", "id long")


def test_sinks(spark, tmp_path):
    at = datetime.datetime(2024, 1, 10)
    rows = spark.createDataFrame([(1, at), (2, at - datetime.timedelta(days=1)), (3, None)], "id int, created_at timestamp_ntz")
    stay, go = sinks.retained(rows, F.col("created_at"), F.lit(at))
    assert {r.id for r in stay.collect()} == {1, 3} and {r.id for r in go.collect()} == {2}
    payloads = spark.createDataFrame([("a", at), ("b", at + datetime.timedelta(1)), ("c", None)], "payload_id string, expires_at timestamp_ntz")
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "gone")], "id int, payload_id string")
    alive, kept = sinks.purged(events, payloads, F.lit(at))
    assert {r.payload_id for r in alive.collect()} == {"b", "c"} and {(r.id, r.payload_id) for r in kept.collect()} == {(1, None), (2, "b"), (3, None), (4, "c"), (5, None)}
    sinks.snapshot({"e": events}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/e")).count() == 5
    first = sinks.write_if_changed(events, str(tmp_path / "conf"), None)
    assert first[1] and sinks.write_if_changed(events, str(tmp_path / "conf"), first[0]) == (first[0], False)
    assert json.loads(spark.read.text(str(tmp_path / "conf")).first().value)
    docs = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc int, at int, line string")
    sinks.documents_as_text(docs, str(tmp_path / "text"), "doc", "at", "line")
    assert [r.value for r in spark.read.text(str(tmp_path / "text/doc=1")).collect()] == ["a", "b"]
    assert sinks.server_events(docs.limit(1), "run").first().value.startswith("event: run\ndata: {")


def test_table_sizes(spark):
    spark.sql("drop table if exists sized")
    spark.range(7).write.saveAsTable("sized")
    assert {tuple(r) for r in files.table_sizes(spark).filter("name = 'sized'").collect()} == {("sized", 7)}
    spark.sql("drop table sized")
