"""All queries by name with the SQL each is compared with. Families register theirs here."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from ..sources.adapter import sql_views

FLAGSHIP = "queue_list"
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame by its name, with its SQL over tables and workflow views."""

    def keep(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"{sql_views(*views)}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if views else sql
        return f

    return keep


for family in ("queue", "runs", "rules", "documents", "events", "texts", "sinks", "views", "decisions", "tasklist", "small", "writes", "drafts", "files", "commits", "graphs", "calls", "stories"):
    import_module(f".{family}", __package__)
