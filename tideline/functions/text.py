"""Column builders for text: truncation, search, checklist lines, codes; all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITIES = ("critical", "high", "medium", "low")


def priority_rank(c: Column) -> Column:
    """0 for the most urgent; 9 for anything unknown."""
    return reduce(lambda w, x: w.when(c == x[1], x[0]), enumerate(PRIORITIES), F.when(F.lit(False), -1)).otherwise(9)


def squeeze(c: Column, limit: int, head: int, mark: str) -> Column:
    """Texts over the limit keep a head and a tail with a mark between."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(limit - head))))


def tail(c: Column, limit: int) -> Column:
    """Texts over the limit keep their end after an ellipsis."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.lit("…"), F.right(c, F.lit(limit - 1))))


def first_paragraph(c: Column, limit: int) -> Column:
    return F.left(F.split(F.trim(c), "\n\n")[0], F.lit(limit))


def contains_or_begins(needle: str, anywhere: Column, at_start: Column) -> Column:
    """Case-blind search; a blank needle lets everything through. Wildcards in the needle work."""
    q = needle.strip()
    return F.lit(True) if not q else anywhere.ilike(f"%{q}%") | at_start.ilike(f"{q}%")


# The marks of checklist lines and what they say; headings, items and task codes.
MARKS = {"-": "todo", "~": "in_progress", "x": "closed", "+": "done", "!": "failed"}
HEADING, ITEM = r"^(#{1,5})\s+(.*)$", r"^([~+x!\-])\s+(.*)$"
CODE = "([A-Z][A-Z0-9]{1,9}-[0-9]+)"


def checklist_line(line: Column) -> Column:
    """A struct (kind, level, text, status) of a trimmed line that is not blank."""
    mark = F.regexp_extract(line, ITEM, 1)
    status = reduce(lambda w, m: w.when(mark == m[0], m[1]), MARKS.items(), F.when(F.lit(False), "")).otherwise("todo")
    of = lambda kind, level, text, state: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), text.alias("text"), state.alias("status"))
    return F.when(line.rlike(HEADING), of("heading", F.length(F.regexp_extract(line, HEADING, 1)), F.regexp_extract(line, HEADING, 2), F.lit(None).cast("string"))).otherwise(of("item", F.lit(None), F.when(line.rlike(ITEM), F.regexp_extract(line, ITEM, 2)).otherwise(line), status))


def codes(c: Column) -> Column:
    """Task codes in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CODE), F.lit(1)))


def whole_minutes(until: Column, since: Column) -> Column:
    """Minutes that have passed in full."""
    return F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 60_000_000).cast("long")


def pauses(raw: Column, default: list[int]) -> Column:
    """A list of minutes from text: parts that are not positive go; any part that is no number makes it the default."""
    parts = F.transform(F.filter(F.split(raw, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    good = F.filter(parts, lambda x: x > 0)
    base = F.array(*map(F.lit, default))
    return F.when(F.exists(parts, lambda x: x.isNull()) | (F.size(good) == 0), base).otherwise(good)
