"""Places of regular expression matches and running sums within a row, as SQL text, in DataFrame functions only.

Spark returns matches without places. What stands between matches is the split at the same expression, so places are
running sums of lengths in code points. Both walk the text once, as Java's matcher does: leftmost, not overlapping.

An array can only grow by copying, so a running sum over n values by one aggregate costs n squared. Here it is done in
blocks of BLOCK values and then over the blocks: n x BLOCK + (n / BLOCK) squared, which is linear up to millions.

A value that a lambda needs is bound by let(): the optimiser may put an expression in the place of a column, and a lambda
would evaluate it anew for each element.
"""

from __future__ import annotations

BLOCK = 64


def let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(values: str, operation: str = "{} + {}", zero: str = "0") -> str:
    """Running results over an array of int, each with its own value: sums, or another associative operation."""
    step = operation.format
    along = lambda xs, start: f"aggregate({xs}, named_struct('out', cast(array() as array<int>), 'at', {start}), (acc_, x_) -> named_struct('out', concat(acc_.out, array({step('acc_.at', 'x_')})), 'at', {step('acc_.at', 'x_')}))"
    blocks = f"transform(sequence(0, (size(all_) - 1) div {BLOCK}), k_ -> slice(all_, k_ * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform(blocks_, c_ -> aggregate(c_, {zero}, (s_, x_) -> {step('s_', 'x_')}))"
    done = let(blocks, "blocks_", let(f"concat(array({zero}), {along(totals, zero)}.out)", "before_", f"flatten(zip_with(blocks_, slice(before_, 1, size(blocks_)), (c_, o_) -> {along('c_', 'o_')}.out))"))
    return let(values, "all_", f"if(size(all_) = 0, cast(array() as array<int>), {done})")


def starts(found: str, gaps: str) -> str:
    """The places of matches; found and gaps are names, gaps the text split at the pattern with limit -1."""
    ends = scan(f"zip_with(slice({gaps}, 1, size({found})), {found}, (g_, m_) -> length(g_) + length(m_))")
    return f"zip_with({ends}, {found}, (e_, m_) -> e_ - length(m_))"


def places(text: str, pattern: str, body: str, kind: str, group: int = 0) -> str:
    """An array of body for each match: in it z.a is its place, z.m the match and v the group.

    pattern is a SQL literal; kind is the type of what body makes.
    """
    each = f"zip_with(zip_with({starts('f_', 'g_')}, f_, (a, m) -> struct(a, m)), v_, (z, v) -> {body})"
    values = let(f"regexp_extract_all({text}, {pattern}, {group})", "v_", each)
    inner = let(f"split({text}, {pattern}, -1)", "g_", values)
    return let(f"regexp_extract_all({text}, {pattern}, 0)", "f_", f"if(size(f_) = 0, cast(array() as array<{kind}>), {inner})")


def united(sorted_spans: str) -> str:
    """Spans (structs with start and end, in order of start) that overlap or touch as one: an array of struct<a, b>."""
    new = "filter(transform(s_, (x, i) -> struct(i as i, x.start as a)), x -> x.i = 0 or x.a > r_[x.i - 1])"
    pair = "zip_with(n_, concat(slice(n_, 2, size(n_)), array(struct(size(s_) as i, 0 as a))), (x, y) -> struct(x.a as a, r_[y.i - 1] as b))"
    body = let(scan("transform(s_, x -> x.end)", "greatest({}, {})", "-1"), "r_", let(new, "n_", pair))
    return let(sorted_spans, "s_", f"if(size(s_) = 0, cast(array() as array<struct<a:int,b:int>>), {body})")
