"""Secret scans: known forms, and a battery of randomness tests, in DataFrame functions only.

Known forms are matched by expression; their places are running sums of lengths (see spans). They are blanked out, and
the other tokens of 20 or more characters with letters and digits are tested. What separates (-, _, /, + and =) is left
out of a token, and the encoding is inferred from what remains: hexadecimal (so of UUIDs), base 32, base 36, or base 62
(so of base 64). Three tests measure, as normal values under "each character is drawn evenly", what ordinary tokens,
which are made of words and numbers, do differently:

    chi-squared         the counts of the alphabet's characters are uneven (Wilson and Hilferty's cube root)
    runs                there are fewer runs of upper case, lower case and digits
    serial correlation  vowels and consonants alternate: neighbours, coded 1 and -1 (digits 0), are less alike

Their weighted mean is near 0 for random tokens of any length, and for ordinary ones it grows with the root of the
length. "The token is ordinary" is the hypothesis that is tested: its p-value is the chance that an ordinary token of this
length looks as random or more so, by a normal distribution whose mean and spread (ORDINARY) were set on tokens made of
program words, in seven styles, so that it errs towards large p-values. Secrets are what the weighted step-up procedure of
Benjamini and Hochberg rejects over the tokens of a text; weights grow with length up to 64, as the tests' power does. So
the expected share of ordinary tokens among those reported is at most LEVEL. Rejected tokens are of kind "random".

All of it works on arrays within a row, so nothing is shuffled and no text's tokens leave their row; the work is close to
proportional to the text (see spans), also for texts that are all tokens.

Defined results: null and empty texts have no spans; equal texts have equal spans; repeated rows each give a row; texts
are scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, spans
from .spans import let

# The contract's forms. The last two ask for the length at once: runs are taken whole either way.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: What is blanked out before tokens are looked for.
KNOWN = f"{ASSIGN[:-2]}{{{ASSIGN_VALUE},}})|{ACCESS}|{HEX}"
#: Tokens for the tests: from a token's first character, with a letter and a digit, padding allowed.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Level of the step-up procedure, and the length from which weights no longer grow.
LEVEL = 0.01
MOST_WEIGHT = 64
#: Weights of the tests chi-squared, runs, serial correlation.
SHARES = (1 / 3, 2 / 3, 2 / 3)
#: Ordinary tokens of m characters: the tests' weighted mean has the mean slope x sqrt(m) + offset, and this spread.
ORDINARY = {"slope": 0.9, "offset": -0.9, "spread": 1.05}
#: Fewer characters than this, without separators, are not tested.
LEAST = 12

#: Encodings in the order in which they are tried: expression, alphabet, shares of letter and digit classes, share of vowels.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", (6 / 16, 10 / 16), 2 / 16),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (26 / 32, 6 / 32), 5 / 32),
    ("^([a-z0-9]+|[A-Z0-9]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", (26 / 36, 10 / 36), 5 / 36),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26 / 62, 26 / 62, 10 / 62), 10 / 62),
)


def moments(classes: tuple[float, ...], vowels: float) -> tuple[float, ...]:
    """Of a random string, for each place: the chance that the class stays (and its cube), mean and mean square of the vowel code."""
    letters = 1 - classes[-1]
    return sum(p * p for p in classes), sum(p**3 for p in classes), 2 * vowels - letters, letters


def _tail(z: str) -> str:
    """The chance of a normal value below z (Abramowitz and Stegun 7.1.26)."""
    x = f"(abs({z}) / sqrt(2.0e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {x}))"
    far = f"0.5e0 * {t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{x} * {x})"
    return f"if({z} < 0, {far}, 1e0 - {far})"


def _by_encoding(s: str, value) -> str:
    """SQL: a value of the encoding that fits the string s."""
    return "case " + " ".join(f"when {s} rlike '{e[0]}' then {value(e)}" for e in ENCODINGS[:-1]) + f" else {value(ENCODINGS[-1])} end"


#: Steps from a token's text to its p-value; each is the body of a lambda over c, the element before.
STEPS = [
    "named_struct('n', length(c), 's', regexp_replace(c, '[^A-Za-z0-9]', ''))",
    f"""named_struct('n', c.n, 'm', cast(length(c.s) as double), 's', if(c.s rlike '{ENCODINGS[0][0]}' or c.s not rlike '[a-z]' and c.s not rlike '^[A-Z2-7]+$', lower(c.s), c.s),
        'e', {_by_encoding("c.s", lambda e: "named_struct('alphabet', '%s', 'k', %de0, 'q2', %re0, 'q3', %re0, 'mean', %re0, 'square', %re0)" % (e[1], len(e[1]), *moments(e[2], e[3])))})""",
    # counts: squared counts of characters; runs of classes; letters, runs of letters, runs of vowels and of consonants
    """named_struct('n', c.n, 'm', c.m, 'e', c.e, 'squares', aggregate(split(c.e.alphabet, ''), 0e0, (acc, a) -> acc + pow(cast(length(c.s) - length(replace(c.s, a, '')) as double), 2e0)),
        'runs', size(regexp_extract_all(c.s, '[0-9]+|[a-z]+|[A-Z]+', 0)), 'letters', length(regexp_replace(c.s, '[0-9]', '')), 'words', size(regexp_extract_all(c.s, '[A-Za-z]+', 0)),
        'sounds', size(regexp_extract_all(c.s, '[AEIOUaeiou]+|[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+', 0)))""",
    # each test as a normal value, upwards towards ordinary tokens
    """named_struct('n', c.n, 'm', c.m,
        'chi', (sign(c.e.k / c.m * c.squares - c.m) * pow(abs(c.e.k / c.m * c.squares - c.m) / (c.e.k - 1), 1e0 / 3e0) - (1e0 - 2e0 / (9e0 * (c.e.k - 1)))) / sqrt(2e0 / (9e0 * (c.e.k - 1))),
        'runs', ((c.m - 1) * (1 - c.e.q2) - (c.runs - 1)) / sqrt((c.m - 1) * c.e.q2 * (1 - c.e.q2) + 2 * (c.m - 2) * (c.e.q3 - c.e.q2 * c.e.q2)),
        'serial', ((c.m - 1) * c.e.mean * c.e.mean - (c.letters - 2 * c.sounds + c.words)) / sqrt((c.m - 1) * (c.e.square * c.e.square - pow(c.e.mean, 4e0)) + 2 * (c.m - 2) * (c.e.mean * c.e.mean * c.e.square - pow(c.e.mean, 4e0))))""",
    f"named_struct('w', cast(least(c.n, {MOST_WEIGHT}) as double), 'z', ((c.chi * {SHARES[0]!r}e0 + c.runs * {SHARES[1]!r}e0 + c.serial * {SHARES[2]!r}e0) - ({ORDINARY['slope']}e0 * sqrt(c.m) + {ORDINARY['offset']}e0)) / {ORDINARY['spread']}e0)",
    f"named_struct('w', c.w, 'p', {_tail('c.z')})",
]

_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _random(text: str, level: float) -> str:
    """SQL: the spans of a text's random tokens; text is a name."""
    gaps = f"zip_with(split({text}, {runtime.quoted(KNOWN)}, -1), known_, (g, m) -> concat(g, repeat(' ', coalesce(length(m), 0))))"
    blank = let(f"regexp_extract_all({text}, {runtime.quoted(KNOWN)}, 0)", "known_", f"if(size(known_) = 0, {text}, array_join({gaps}, ''))")
    token = f"if(length(regexp_replace(z.m, '[^A-Za-z0-9]', '')) >= {LEAST}, named_struct('start', z.a, 'rank', 3, 'kind', 'random', 'end', z.a + length(z.m), 'm', z.m), null)"
    tokens = let(blank, "blank_", f"filter({spans.places('blank_', runtime.quoted(TOKEN), token, 'struct<start:int,rank:int,kind:string,end:int,m:string>')}, t -> t is not null)")
    tested = "transform(tokens_, t -> t.m)"
    for step in STEPS:
        tested = f"transform({tested}, c -> {step})"
    # weighted step-up: p over weight (mean 1), smallest first; those up to the last under its line are secrets
    line = let("array_sort(transform(tested_, c -> c.p / (c.w / mean_)))", "sorted_", f"array_max(transform(sorted_, (q, i) -> if(q <= {level!r}e0 * (i + 1) / size(sorted_), q, -1e0)))")
    spans_of = "transform(filter(zip_with(tokens_, tested_, (t, c) -> struct(t, c.p / (c.w / mean_) as q)), x -> x.q <= line_), x -> struct(x.t.start as start, x.t.rank as rank, x.t.kind as kind, x.t.end as end))"
    found = let(tested, "tested_", let("aggregate(tested_, 0e0, (s, c) -> s + c.w) / size(tested_)", "mean_", let(line, "line_", spans_of)))
    return let(tokens, "tokens_", f"if(size(tokens_) = 0, cast(array() as array<{_SPAN}>), {found})")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), level: float = LEVEL) -> DataFrame:
    """Per row: the id column, the columns of keep, and found: an array of (start, rank, kind, end) in order of start.

    Places are code points, ends exclusive; rank is the kind's place in KINDS. Base kinds come first at equal starts.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    span = "named_struct('start', z.a, 'rank', {1}, 'kind', '{0}', 'end', z.a + length(z.m))"
    base = []
    for rank, (kind, pattern) in enumerate({"assign": ASSIGN, "access": ACCESS, "hex": HEX}.items()):
        body = span.format(kind, rank)
        if kind == "assign":
            body = f"if(length(v) >= {ASSIGN_VALUE}, {body}, null)"
        base.append(spans.places("doc_", runtime.quoted(pattern), body, _SPAN, 2 if kind == "assign" else 0))
    every = let("coalesce(text, '')", "doc_", f"array_sort(concat(filter({base[0]}, x -> x is not null), {base[1]}, {base[2]}, {_random('doc_', level)}))")
    rows = df.select(*map(runtime.column, kept), runtime.column(text_col)).toDF(*(f"in_{i}" for i in range(len(kept))), "text")
    return rows.select(*rows.columns[:-1], F.expr(every)).toDF(*kept, "found")


def listed(found: str, where: str = "true") -> str:
    """kind:start:end of spans in order, joined by commas."""
    return f"array_join(transform(filter({found}, x -> {where}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with the text's secrets replaced by mark; spans that overlap or touch become one. Null texts stay null.

    Columns and rows are otherwise as they were; df's columns go by numbered names until the end.
    """
    rows = runtime.numbered(df)
    columns, text = rows.columns, f"in_{df.columns.index(text_col)}"
    rows = find(rows.withColumn("row", F.struct(*columns)), "row", text)
    # what stays is what lies between the cuts; a cut ends where the next piece begins. Places in a text are found by
    # counting from its start, so pieces are taken from blocks of them, as many as there are pieces in a block
    pieces = "zip_with(concat(array(0), transform(cut_, x -> x.b)), concat(transform(cut_, x -> x.a), array(length(doc_))), (a, b) -> struct(a, b))"
    blocks = "transform(sequence(0, (size(all_) - 1) div many_), k -> slice(all_, k * many_ + 1, many_))"
    within = let("substring(doc_, p[0].a + 1, element_at(p, -1).b - p[0].a)", "part_", f"array_join(transform(p, x -> substring(part_, x.a - p[0].a + 1, x.b - x.a)), '{mark}')")
    joined = let(pieces, "all_", let("cast(ceil(sqrt(size(all_))) as int)", "many_", f"array_join(transform({blocks}, p -> {within}), '{mark}')"))
    stays = let(spans.united("found"), "cut_", f"if(size(cut_) = 0, doc_, {joined})")
    clean = let(f"row.{text}", "doc_", stays)
    return rows.select(*(F.expr(clean).alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in columns)).toDF(*df.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of secrets in every whole text of documents."""
    rows = find(runtime.table(spark, sf_dir, "documents", "doc_id", "text"))
    count = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *count, F.expr(f"sha2({listed('found', 'x.rank < 3')}, 256)").alias("base_sha256"), F.expr(listed("found")).alias("spans"))


def _sql() -> str:
    """Matches and the gaps between them by place; the tests on counts of expressions' matches."""
    token = r"[A-Za-z0-9+/_-]{20,}={0,2}"
    found = lambda kind, rank, pattern, value, where, t="t": f"""select r, '{kind}' as kind, {rank} as rank, start, start + length(m) as stop, m from (
      select r, unnest(ms) as m, unnest(vs) as v, unnest(list_transform(range(1, len(ms) + 1), lambda i: cast(list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0) as bigint))) as start
      from (select r, regexp_extract_all({t}, $p${pattern}$p$) as ms, regexp_extract_all({t}, $p${pattern}$p$, {value}) as vs, regexp_split_to_array({t}, $p${pattern}$p$) as gaps from {"d" if t == "t" else "blank"}) where len(ms) > 0) where {where}"""  # noqa: E731
    known = KNOWN.replace("((?i:", "(?:(?i:").replace("([A-Za-z0-9+", "(?:[A-Za-z0-9+")
    which = "case " + " ".join(f"when regexp_matches(s, '{e[0]}') then {i}" for i, e in enumerate(ENCODINGS[:-1])) + f" else {len(ENCODINGS) - 1} end"
    table = ", ".join("(%d, '%s', %de0, %re0, %re0, %re0, %re0)" % (i, e[1], len(e[1]), *moments(e[2], e[3])) for i, e in enumerate(ENCODINGS))
    tail = _tail("z").replace("if(z < 0, ", "case when z < 0 then ").replace(", 1e0 - ", " else 1e0 - ")[:-1] + " end"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), base as ({found("assign", 0, ASSIGN, 2, f"length(v) >= {ASSIGN_VALUE}")} union all {found("access", 1, ACCESS, 0, "true")} union all {found("hex", 2, HEX, 0, "true")}
), blank as (select r, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || repeat(' ', coalesce(length(ms[i]), 0))), '') as b from (select r, regexp_extract_all(t, $p${known}$p$) as ms, regexp_split_to_array(t, $p${known}$p$) as gaps from d)
), token as (select row_number() over () as id, *, regexp_replace(m, '[^A-Za-z0-9]', '', 'g') as bare from ({found("random", 3, token, 0, f"regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and length(regexp_replace(m, '[^A-Za-z0-9]', '', 'g')) >= {LEAST}", "b")})
), encoding(e, alphabet, k, q2, q3, mean, square) as (values {table}
), coded as (select id, length(m) as n, cast(length(bare) as double) as m, {which.replace("(s,", "(bare,")} as e, bare from token
), folded as (select coded.*, alphabet, k, q2, q3, mean, square, case when e in (0, 2) then lower(bare) else bare end as s from coded join encoding using (e)
), ch as (select id, unnest(string_split(s, '')) as c from folded
), sq as (select id, sum(many * many) as squares from (select id, c, cast(count(*) as double) as many from ch group by id, c) group by id
), counted as (select *, len(regexp_extract_all(s, '[0-9]+|[a-z]+|[A-Z]+')) as runs, length(regexp_replace(s, '[0-9]', '', 'g')) as letters, len(regexp_extract_all(s, '[A-Za-z]+')) as words, len(regexp_extract_all(s, '[AEIOUaeiou]+|[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+')) as sounds from folded join sq using (id)
), tests as (select id, n, m, (sign(k / m * squares - m) * pow(abs(k / m * squares - m) / (k - 1), 1e0 / 3e0) - (1e0 - 2e0 / (9e0 * (k - 1)))) / sqrt(2e0 / (9e0 * (k - 1))) as chi,
    ((m - 1) * (1 - q2) - (runs - 1)) / sqrt((m - 1) * q2 * (1 - q2) + 2 * (m - 2) * (q3 - q2 * q2)) as run,
    ((m - 1) * mean * mean - (letters - 2 * sounds + words)) / sqrt((m - 1) * (square * square - pow(mean, 4)) + 2 * (m - 2) * (mean * mean * square - pow(mean, 4))) as serial from counted
), z as (select id, least(n, {MOST_WEIGHT}) as w, ((chi * {SHARES[0]!r}e0 + run * {SHARES[1]!r}e0 + serial * {SHARES[2]!r}e0) - ({ORDINARY["slope"]}e0 * sqrt(m) + {ORDINARY["offset"]}e0)) / {ORDINARY["spread"]}e0 as z from tests
), w as (select token.*, ({tail}) / (w / avg(w) over (partition by r)) as q from token join z using (id)
), o as (select *, q <= {LEVEL!r}e0 * row_number() over (partition by r order by q) / count(*) over (partition by r) as under from w
), kept as (select * from o where q <= coalesce((select max(q) from o x where x.r = o.r and under), -1)
), every as (select r, kind, rank, start, stop from base union all select r, kind, rank, start, stop from kept
), lists as (select r, count(*) filter (where rank = 0) as a, count(*) filter (where rank = 1) as b, count(*) filter (where rank = 2) as c, count(*) filter (where rank = 3) as e,
    string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) filter (where rank < 3) as base_list, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as spans from every group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, coalesce(e, 0) as n_random, sha256(coalesce(base_list, '')) as base_sha256, coalesce(spans, '') as spans from d left join lists using (r)
"""


SQL = _sql()
