"""Column builders for short labels, tags, classification by markers, and parsing of command output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages that say that a provider could not be reached. Case counts.
UNREACHABLE = ("Can't reach the API server", "EAI_AGAIN", "ENOTFOUND", "ECONNREFUSED", "ETIMEDOUT", "ECONNRESET", "fetch failed")
# The tags that say who made a task; one of them always comes first.
AUTHORS = ("by_human", "by_ai")


def abbreviated(n: Column) -> Column:
    """1234 as 1K, halves up; small numbers as they are; nothing for zero."""
    return F.when(n == 0, "").when(n >= 1000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun after a number, in languages with three forms."""
    tens, units = n % 100, n % 10
    return F.when((units == 1) & (tens != 11), one).when(units.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)


def unreachable(c: Column) -> Column:
    said = F.coalesce(c, F.lit(""))
    return reduce(lambda a, b: a | b, (F.contains(said, F.lit(m)) for m in UNREACHABLE))


def tags(author: Column, more: Column, most: int = 5, longest: int = 64) -> Column:
    """A struct: tags, the author's first, then the others trimmed, without leading #, each once in order; and error.

    An author's tag among the others is passed over. error names the first rule that is broken: author, length, or number.
    """
    clean = F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "^#+", ""))
    kept = F.filter(clean, lambda x: (x != "") & ~x.isin(*AUTHORS))
    every = F.concat(F.array(author), F.array_distinct(kept))
    error = F.when(~F.coalesce(author.isin(*AUTHORS), F.lit(False)), "author").when(F.exists(kept, lambda x: F.length(x) > longest), "length").when(F.size(every) > most, "number")
    return F.struct(every.alias("tags"), error.alias("error"))


def guessed(text: Column, labels: Column, words: dict[str, str]) -> Column:
    """The status that a text speaks of. labels: an array of (key, label) of the flow's statuses.

    Of the labels that the text contains the longest decides (the first of equal ones); without any, the first word of
    the list whose status the flow has.
    """
    low = F.lower(text)
    said = F.filter(labels, lambda x: (F.trim(x["label"]) != "") & F.contains(low, F.lower(F.trim(x["label"]))))
    best = F.element_at(F.array_sort(said, lambda a, b: F.length(F.trim(b["label"])) - F.length(F.trim(a["label"]))), 1)["key"]
    known = F.transform(labels, lambda x: x["key"])
    return F.when(F.size(said) > 0, best).otherwise(F.coalesce(*(F.when(F.contains(low, F.lit(w)) & F.array_contains(known, k), F.lit(k)) for w, k in words.items())))


def kept_path(line: Column, keep: tuple[str, ...]) -> Column:
    """Whether a line of short status output is about a path under one of the given beginnings."""
    path = changed_path(line)
    return reduce(lambda a, b: a | b, (F.startswith(path, F.lit(k)) for k in keep))


def runner_errors(tools: Column, servers: Column, skills: Column) -> Column:
    """What is wrong with a runner's fields: names of tools (32 of 96 characters without white space at most), servers (1 to 16,
    each with a url or a command; a map of name to a struct with these), skills (8 at most). Blank entries do not count."""
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    bad = F.exists(clean(tools), lambda x: (F.length(x) > 96) | x.rlike(r"\s"))
    empty = F.exists(F.map_values(servers), lambda v: (F.coalesce(v["url"], F.lit("")) == "") & (F.coalesce(v["command"], F.lit("")) == ""))
    found = F.array(F.when((F.size(clean(tools)) > 32) | bad, "tools"), F.when(servers.isNotNull() & (~F.size(servers).between(1, 16) | empty), "servers"), F.when(F.size(clean(skills)) > 8, "skills"))
    return F.filter(found, lambda x: x.isNotNull())


def confirmed(c: Column, words: tuple[str, ...] = ("yes", "ok", "okay", "confirm", "do it")) -> Column:
    return F.coalesce(c.rlike(rf"(?i)^\s*({'|'.join(words)})[.!]?\s*$"), F.lit(False))


def changed_path(line: Column) -> Column:
    """The path of a line of short status output; the new one of a rename."""
    path = F.substring(line, 4, 1 << 20)
    return F.element_at(F.split(path, " -> "), -1)


def masked(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.concat(F.lit("****"), F.right(c, F.lit(4)))).otherwise("****")
