"""Checks of flows before they are published, for many drafts at once: one row for each problem.

A flow is a small graph, of dozens of statuses: each draft becomes one row of two arrays, and all rules, the walks along
its edges among them, are expressions over that row. So any number of drafts costs two aggregates and one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "^[a-z0-9_]+$"


def _each(found: str, level: str, problem: str, subject: str) -> str:
    """SQL: a problem for each element x of an array."""
    return f"transform({found}, x -> struct('{level}' as level, '{problem}' as problem, {subject} as subject))"


def _once(which: str, level: str, problem: str, subject: str = "''") -> str:
    """SQL: a problem of the whole draft if a condition holds."""
    return _each(f"filter(array({subject}), x -> {which})", level, problem, "x")


def walked(start: str, moves: str, most: int) -> str:
    """SQL: the keys reachable from an array of keys by an array of struct<a, b> in at most so many steps."""
    return f"aggregate(sequence(1, {most}), array_distinct({start}), (seen, i) -> array_union(seen, transform(filter({moves}, m -> array_contains(seen, m.a)), m -> m.b)))"


def problems(statuses: DataFrame, edges: DataFrame, predicates: Sequence[str], most: int) -> DataFrame:
    """draft, level (error or warning), problem and subject.

    statuses: draft, key, is_entry, is_terminal, is_blocking, alias; edges: draft, a, b, runner, when (array). most: the
    number of statuses of the largest draft. Graphs are looked at only in drafts without an error of form.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    nodes = statuses.groupBy("draft").agg(F.collect_list(F.struct(F.coalesce("key", F.lit("")).alias("key"), flag("is_entry"), flag("is_terminal"), flag("is_blocking"), F.coalesce("alias", F.lit("")).alias("alias"))).alias("s"))
    moves = edges.groupBy("draft").agg(F.collect_list(F.struct("a", "b", "runner", F.coalesce("when", F.array().cast("array<string>")).alias("when"))).alias("e"))
    none = F.array().cast("array<struct<a:string,b:string,runner:string,when:array<string>>>")
    rows = nodes.join(moves, "draft", "left").withColumn("e", F.coalesce("e", none))
    keys_of = lambda which: f"transform(filter(s, x -> {which}), x -> x.key)"
    for name, value in {"keys": keys_of("true"), "entries": keys_of("x.is_entry"), "ends": keys_of("x.is_terminal"), "ways": keys_of("x.is_terminal or x.is_blocking"), "back": "transform(e, x -> struct(x.b as a, x.a as b))", "known": f"array({', '.join(repr(p) for p in predicates)})"}.items():
        rows = rows.withColumn(name, F.expr(value))
    edge = "concat(x.a, '>', x.b)"
    form = [
        _once("size(array_distinct(keys)) < size(keys)", "error", "duplicate_key"),
        _each(f"filter(keys, x -> x not rlike '{KEY}')", "error", "bad_key", "x"),
        _once("size(entries) <> 1", "error", "entry_count", "cast(size(entries) as string)"),
        _once("size(ends) = 0", "error", "no_terminal"),
        _each("array_distinct(transform(filter(e, x -> array_contains(ends, x.a)), x -> x.a))", "error", "leaves_terminal", "x"),
        _each("filter(e, x -> not array_contains(keys, x.a))", "error", "unknown_source", edge),
        _each("filter(e, x -> not array_contains(keys, x.b))", "error", "unknown_target", edge),
    ]
    rows = rows.withColumn("form", F.expr(f"concat({', '.join(form)})")).withColumn("fore", F.expr(walked("entries", "e", most))).withColumn("ending", F.expr(walked("ends", "back", most)))
    graph = [
        _each("filter(s, x -> not x.is_terminal and not exists(e, m -> m.a = x.key))", "error", "dead_end", "x.key"),
        _each("filter(e, x -> x.runner = 'auto' and size(x.when) = 0)", "warning", "auto_without_conditions", edge),
        _each("filter(e, x -> size(x.when) > 0 and array_contains(ways, x.b))", "error", "gated_escape", edge),
        _each("filter(e, x -> size(array_except(x.when, known)) > 0)", "error", "unknown_predicate", f"concat({edge}, ' ', array_join(array_except(x.when, known), ','))"),
        _each("filter(keys, x -> not array_contains(fore, x))", "error", "unreachable", "x"),
        _each("filter(keys, x -> not array_contains(ending, x))", "error", "no_way_to_end", "x"),
        _once("not array_contains(keys, 'canceled') or not array_contains(keys, 'blocked')", "warning", "no_escapes"),
        _each("filter(s, x -> x.alias = '')", "warning", "no_column", "x.key"),
    ]
    found = rows.select("draft", F.explode(F.expr(f"if(size(form) > 0, form, concat({', '.join(graph)}))")).alias("x"))
    return found.select("draft", "x.level", "x.problem", "x.subject")
