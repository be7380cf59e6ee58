"""Operators on small rows with nulls, ties and empty sides, which the input tables do not have."""

import itertools

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.operators import relational as R
from tideline.operators import reports, rules
from tideline.operators import tasks as T
from tideline.plans.rules import MIRROR


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def literal(status, kids, flags):
    """Mirroring written out as branches."""
    active, closed, blocked = any(k in rules.ACTIVE for k in kids), bool(kids) and all(k in ("done", "canceled") for k in kids), bool(kids) and all(k == "blocked" for k in kids)
    plan, approved, rejected, m5 = flags
    if status == "todo":
        return ("in_progress", "M1") if active else (None, None)
    if status == "in_progress":
        return ("qa_ready", "M2") if closed else ("blocked", "M5") if blocked else (None, None)
    if status == "qa_ready":
        return ("psi_review", "M3a") if plan else (None, None)
    if status == "psi_review":
        return ("in_progress", "M1") if active else ("qa_ready", "M3c") if rejected else ("in_testing", "M3b") if approved else (None, None)
    if status == "in_testing":
        return ("in_progress", "M1") if active else (None, None)
    if status == "blocked":
        return ("in_progress", "M1") if active else ("qa_ready", "M2") if closed and m5 else (None, None)
    return None, None


def test_mirroring_golden(spark):
    kids = {"mixed": ["done", "in_progress"], "closed": ["done", "canceled"], "blocked": ["blocked", "blocked"], "none": [], "one": ["in_review"]}
    flags = [(False, False, False, False), (True, False, False, True), (True, True, False, False), (True, False, True, True)]
    cases = list(itertools.product(["pending", "todo", "in_progress", "qa_ready", "psi_review", "in_testing", "blocked", "done"], kids, flags))
    facts = []
    for i, (status, k, (plan, ok, bad, m5)) in enumerate(cases):
        c = kids[k]
        facts.append((i, status, "M5" if m5 else None, 2 if plan else None, 2, "approved" if ok else "rejected" if bad else None, ok, len(c) or None, any(x in rules.ACTIVE for x in c) if c else None, all(x in ("done", "canceled") for x in c) if c else None, all(x == "blocked" for x in c) if c else None))
    df = spark.createDataFrame(facts, "id int, status_key string, blocked_rule string, plan_ref int, ref_version int, manager_state string, manager_current boolean, n int, any_active boolean, all_closed boolean, all_blocked boolean")
    edges = spark.createDataFrame(MIRROR, "at string, target string, rule string, when array<string>, position int")
    got = {r.id: (r.target, r.rule) for r in rules.mirrored(df, edges, ["id"]).collect()}
    assert len(cases) == 160 and got == {i: literal(s, kids[k], f) for i, (s, k, f) in enumerate(cases)}


def test_unknown_predicate_is_an_error(spark):
    facts = spark.createDataFrame([(1, "a", None, None, 1, None, None, None, None, None, None)], "id int, status_key string, blocked_rule string, plan_ref int, ref_version int, manager_state string, manager_current boolean, n int, any_active boolean, all_closed boolean, all_blocked boolean")
    edges = spark.createDataFrame([("a", "b", "r", ["nobody"], 1)], "at string, target string, rule string, when array<string>, position int")
    with pytest.raises(Exception, match="unknown predicate nobody"):
        rules.mirrored(facts, edges, ["id"]).collect()


def test_upsert_and_diff(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int"), spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, v string, w int")
    assert rows(R.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert rows(R.upsert(old, new.limit(0), ["k"])) == rows(old)
    assert rows(R.diff(old.fillna("", ["v"]), new.fillna("", ["v"]), "k", "v")) == [(1, "removed"), (2, "updated"), (3, "added")]


def test_insert_absent_versions_claims(spark):
    opened = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("c", None)], "k string, at int")
    order = [F.col("at").asc_nulls_last()]
    assert rows(R.insert_absent(opened, new, ["k"], order)) == [("b", 1), ("c", None)]
    known = spark.createDataFrame([("b", 7)], "k string, version int")
    assert rows(R.next_versions(known, new, ["k"], order).select("k", "at", "version")) == [("a", 1, 1), ("b", 1, 8), ("b", 2, 9), ("c", None, 1)]
    asked = spark.range(1000).selectExpr("id", "id % 100 as item", "id % 2 as worker")
    won = R.claims(asked, "item", [F.col("id")]).filter("won")
    assert won.count() == 100 and won.select("item").distinct().count() == 100


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "a string, b string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(R.closure(edges, start, 5)) == [("a",), ("b",), ("c",)]


def test_text_builders(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 10,), ("  head\n\ntail",)], "t string")
    got = df.select(X.squeeze(F.col("t"), 6, 2, "~"), X.tail(F.col("t"), 4), X.first_paragraph(F.col("t"), 300)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("", "", ""), ("xx~xxxx", "…xxx", "x" * 10), ("  ~tail", "…ail", "head")]
    lines = spark.createDataFrame([("## Two",), ("- a",), ("! b",), ("plain",), ("x",)], "l string").select(X.checklist_line(F.col("l")).alias("x")).select("x.*")
    assert [tuple(r) for r in lines.collect()] == [("heading", 2, "Two", None), ("item", None, "a", "todo"), ("item", None, "b", "failed"), ("item", None, "plain", "todo"), ("item", None, "x", "todo")]
    pause = spark.createDataFrame([("",), (None,), ("1, 5",), ("0,-1",), ("2,x",)], "p string").select(X.pauses(F.col("p"), [9]).alias("p")).collect()
    assert [r.p for r in pause] == [[9], None, [1, 5], [9], [9]]


def decision(spark, **facts):
    base = {"current": "in_progress", "target": "in_review", "target_known": True, "runner": "agent", "cond_links": False, "cond_checklist": False, "cond_artifact": False, "subject": "agent", "assigned": True, "current_terminal": False, "blocked": False, "plan_stale": False, "psi_failed": 0, "source_gate": "developer", "target_gate": "reviewer", "source_state": (3, 0, 0), "target_state": (1, 1, 0), "has_report": True}
    schema = "current string, target string, target_known boolean, runner string, cond_links boolean, cond_checklist boolean, cond_artifact boolean, subject string, assigned boolean, current_terminal boolean, blocked boolean, plan_stale boolean, psi_failed long, source_gate string, target_gate string, source_state struct<total:long,open:long,failed:long>, target_state struct<total:long,open:long,failed:long>, has_report boolean"
    names = list(facts)
    cases = [dict(zip(names, values)) for values in zip(*facts.values())]
    df = spark.createDataFrame([(i, *(base | c).values()) for i, c in enumerate(cases)], "id int, " + schema)
    return [r.code for r in df.withColumn("code", rules.decided(df)).orderBy("id").collect()]


def test_decisions_golden(spark):
    """The gates one by one, and which of two that deny is named."""
    checks = {"cond_checklist": True}
    cases = [
        ({}, "ok"), ({"runner": None}, "no_edge"), ({"runner": None, "target_known": False}, "no_status"), ({"subject": "auto"}, "runner_auto"), ({"subject": "auto", "runner": "auto_or_agent"}, "ok"), ({"subject": "human", "runner": "auto"}, "ok"),
        ({"assigned": False}, "agent_not_assigned"), ({"assigned": False, "runner": "human"}, "agent_not_assigned"), ({"runner": "human"}, "runner_agent"), ({"target": "canceled"}, "agent_cancel"), ({"target": "canceled", "subject": "human"}, "ok"), ({"current_terminal": True}, "agent_terminal"),
        ({"cond_links": True, "blocked": True}, "links_blocked"), ({"cond_links": True, "blocked": True, "target": "done"}, "ok"), ({"target": "done", "plan_stale": True, "psi_failed": 2}, "plan_stale"), ({"target": "done", "psi_failed": 2}, "psi_failed"), ({"plan_stale": True, "psi_failed": 2}, "ok"),
        (checks, "ok"), (checks | {"source_state": None}, "checklist_not_created"), (checks | {"source_state": (0, 0, 0)}, "checklist_not_created"), (checks | {"source_state": (3, 1, 1)}, "checklist_not_closed"), (checks | {"source_state": (3, 0, 1)}, "checklist_failed"), (checks | {"source_gate": None, "source_state": None}, "ok"),
        (checks | {"target": "blocked", "source_state": None, "subject": "human"}, "ok"), (checks | {"current": "in_testing", "target": "in_progress", "source_state": (2, 2, 0)}, "ok"), (checks | {"current": "in_testing", "target": "in_progress", "target_state": None}, "checklist_not_created"),
        (checks | {"target_state": None}, "checklist_not_created"), (checks | {"target_state": None, "runner": "auto", "subject": "auto"}, "ok"), (checks | {"current": "in_testing", "target_state": None}, "ok"), (checks | {"target_gate": None, "target_state": None}, "ok"),
        ({"cond_artifact": True, "has_report": False}, "artifact_missing"), ({"cond_artifact": True, "has_report": False, "current": "todo"}, "ok"), (checks | {"cond_artifact": True, "has_report": False, "source_state": (1, 1, 0)}, "checklist_not_closed"),
    ]
    names = sorted({k for c, _ in cases for k in c})
    base = {"current": "in_progress", "target": "in_review", "target_known": True, "runner": "agent", "cond_links": False, "cond_checklist": False, "cond_artifact": False, "subject": "agent", "assigned": True, "current_terminal": False, "blocked": False, "plan_stale": False, "psi_failed": 0, "source_gate": "developer", "target_gate": "reviewer", "source_state": (3, 0, 0), "target_state": (1, 1, 0), "has_report": True}
    got = decision(spark, **{n: [c.get(n, base[n]) for c, _ in cases] for n in names})
    assert got == [want for _, want in cases]


def test_numbers_by_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 = 0 as k").repartition(7)
    got = R.numbered(df, ["k"], [F.floor(F.col("id") / 64)], [F.col("id")]).collect()
    want = {}
    for k in (True, False):
        want |= {i: n for n, i in enumerate((i for i in range(5000) if (i % 3 == 0) == k), 1)}
    assert {r.id: r.number for r in got} == want and R.numbered(df.limit(0), ["k"], [F.col("id")], [F.col("id")]).count() == 0


def test_task_lists(spark):
    cards = spark.createDataFrame([("TK-1", "Alpha 100%", "AB", "bug", "todo", "low", 1), ("TK-12", "beta", "CD", "story", "done", "critical", 2), ("XX-1", "tk-1 gamma", "AB", "bug", "canceled", None, 3), ("XX-2", None, "CD", "bug", "odd", "high", 4)], "code string, title string, mnemonic string, type_key string, status_key string, priority string, created_at int")
    terminal = spark.createDataFrame([("story", "done", True), ("bug", "canceled", None), ("bug", "todo", False)], "type_key string, status_key string, is_terminal boolean")
    codes = lambda **a: sorted(r.code for r in T.chosen(cards, terminal=terminal, **a).collect())
    assert codes() == codes(q="  ") == codes(projects=[]) == ["TK-1", "TK-12", "XX-1", "XX-2"]
    assert codes(q=" tk-1 ") == ["TK-1", "TK-12", "XX-1"] and codes(q="K-1") == ["XX-1"] and codes(projects=["ab"], types=["bug"]) == ["TK-1", "XX-1"]
    assert codes(exclude_terminal=True) == ["TK-1", "XX-1", "XX-2"]
    assert [r.code for r in T.page(cards, 2).collect()] == ["TK-12", "XX-2"] and [r.code for r in T.page(cards, 2, 2).collect()] == ["TK-1", "XX-1"]
    assert sorted(r.code for r in T.found(cards, q="k-1").collect()) == ["TK-1", "TK-12", "XX-1"] and T.found(cards, "cd", "odd").first().code == "XX-2"
    assert T.at_most_one(cards, code="TK-1").count() == 1 and T.at_most_one(cards, code="none").count() == 0
    with pytest.raises(ValueError):
        T.at_most_one(cards, type_key="bug")
    with pytest.raises(ValueError):
        T.page(cards, 201)


def test_read_only_statements(spark):
    df = spark.range(100)
    assert reports.read_only(spark, "select id from {t};", t=df).count() == 50
    assert reports.read_only(spark, "with drop as (select 'delete; from' as id from {t}) select id from drop -- set", t=df).first().id == "delete; from"
    for bad in ("delete from {t}", "select 1; select 2", "with x as (select 1) insert into y select * from x", "set a = 1", "explain select 1", "create table z as select 1", "drop view x", "show tables", "describe {t}", "refresh table z", "call p()", "cache table z as select 1", "nonsense", "use x", "truncate table z", "insert into y values (1)"):
        with pytest.raises(ValueError):
            reports.read_only(spark, bad, t=df)


def test_scheduler_rows_grow_no_faster_than_tasks(spark):
    from tideline.plans.decisions import scheduler_decisions
    from tideline.sources.adapter import table

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        tasks = table(spark, sf, "task").filter("status_key in ('todo', 'in_progress', 'in_review', 'in_testing')").count()
        assert tasks / 2 < scheduler_decisions(spark, sf).count() < 2 * tasks
