"""Task lists by argument: filters that apply only if given, look-ups by key, searches and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import relational as R

#: The bounds of a page.
LEAST, MOST = 1, 200


def queue_order() -> list[Column]:
    """Urgency, bugs first, age, code."""
    return [X.priority_rank(F.col("priority")), F.col("type_key") != "bug", F.col("created_at"), F.col("code")]


def chosen(cards: DataFrame, projects: Sequence[str] | None = None, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None, q: str | None = None, exclude_terminal: bool = False, terminal: DataFrame | None = None) -> DataFrame:
    """Cards that satisfy every argument given; an empty list and a blank q count as not given.

    Mnemonics are read in any case. q is trimmed and looked for anywhere in titles and at the start of codes, in any case.
    exclude_terminal drops cards whose status is known as terminal by terminal (type_key, status_key, is_terminal); a
    status that it does not know, or has as null, is open.
    """
    when: list[Column] = []
    if projects:
        when.append(F.col("mnemonic").isin(*(p.upper() for p in projects)))
    if types:
        when.append(F.col("type_key").isin(*types))
    if statuses:
        when.append(F.col("status_key").isin(*statuses))
    if q and q.strip():
        when.append(X.contains_or_begins(q, F.col("title"), F.col("code")))
    out = cards.filter(reduce(lambda a, b: a & b, when)) if when else cards
    if exclude_terminal:
        if terminal is None:
            raise ValueError("exclude_terminal needs the current statuses")
        out = out.join(terminal.filter("is_terminal").select("type_key", "status_key"), ["type_key", "status_key"], "left_anti")
    return out


def page(cards: DataFrame, limit: int = 50, offset: int = 0, order: Sequence[Column] | None = None) -> DataFrame:
    if not LEAST <= limit <= MOST or offset < 0:
        raise ValueError(f"a page has {LEAST} to {MOST} rows")
    return R.top(cards, order or queue_order(), limit, offset)


def found(cards: DataFrame, project: str | None = None, status: str | None = None, q: str | None = None, limit: int = 25) -> DataFrame:
    """A search's first rows, newest first: q anywhere in titles or codes, in any case."""
    when = [F.col("mnemonic") == project.upper()] if project else []
    when += [F.col("status_key") == status] if status else []
    when += [F.col("title").ilike(f"%{q}%") | F.col("code").ilike(f"%{q}%")] if q else []
    return R.top(cards.filter(reduce(lambda a, b: a & b, when)) if when else cards, [F.desc("created_at"), F.col("code")], limit)


def at_most_one(df: DataFrame, **values) -> DataFrame:
    """The row whose columns have these values, or none; more than one is an error."""
    rows = df.filter(reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in values.items()))).limit(2)
    several = rows.agg(F.count(F.lit(1)).alias("n")).first().n > 1
    if several:
        raise ValueError(f"more than one row for {values}")
    return rows
