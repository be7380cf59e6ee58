"""PII: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

One expression finds what may be personal: e-mail addresses, payment cards, phone numbers, IPv4 addresses, social
security numbers and dates. A match counts if it is valid: a card's check digit (Luhn), the ranges of an area, group
and serial number, a day that exists. Its value is a number in a domain of two factors, and a Feistel network adds keyed
hashes of one half to the other, modulo that half's factor, in turn. That is a permutation of the domain itself, so no
walking is needed: a pseudonym is valid in the same format, different values get different pseudonyms, and equal values
get equal ones in every document and run with the same key.

    card       all digits but the check digit; the check digit is computed afresh; separators stay
    phone      of North American numbers (ten digits, or eleven from 1) 800 area codes from 200, or 200 below, x 10 ** 7;
               of others up to ten digits from the fourth on; country code, brackets and separators stay
    address    65536 x 65536
    ssn        (898 areas x 99 groups) x 9999 serials
    date       17 x 4297 days: 1900-01-01 to 2099-12-31, written in the form it had; 12/31/1999, which is a date with the
               month first only, has a domain of its own: 2400 months x days 13 to 28, and for a later day the
               years that have it, 20 x 10 (7 x 7 for the 29th of February)

An e-mail address has no fixed format to permute within; its pseudonym is a keyed hash at a reserved domain.

Defined results: a null text stays null, an empty one empty; matches that are not valid stay as they are; equal texts
give equal results; repeated rows each give a row; texts are worked through whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, spans

ROUNDS = 8
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Forms in order of preference at one place. Loops that could be tried again from within start at a boundary.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-1][0-9]-[0-3][0-9]|[0-3][0-9]\.[0-1][0-9]\.(?:19|20)[0-9]{2}|[0-3][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-])(?!\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "address": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+?1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
#: A place that begins with none of a number's first characters is passed over at once.
ANY = f"(?:{FORMS['email']})|(?=[0-9+(])(?:{'|'.join(p for k, p in FORMS.items() if k != 'email')})"


def _hash(key: str, tweak: str, value: str, modulus: str) -> str:
    return f"pmod(cast(conv(substring(sha2(concat_ws('|', {key}, {tweak}, cast({value} as string)), 256), 1, 15), 16, 10) as bigint), {modulus})"


def feistel(key: str, tweak: str, left: str, right: str, high: str, low: str) -> str:
    """SQL: the pair (l, r) after ROUNDS rounds; left is under `high` and right under `low`, before and after."""
    odd = f"named_struct('l', pmod(s.l + {_hash(key, f'concat({tweak}, i)', 's.r', high)}, {high}), 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', pmod(s.r + {_hash(key, f'concat({tweak}, i)', 's.l', low)}, {low}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 1, {odd}, {even}))"


def _digits(key: str, tweak: str, digits: str) -> str:
    """SQL: a permutation of the digit strings of the same length (two digits at least)."""
    n = f"length({digits})"
    half = f"({n} div 2)"
    high, low = f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, {n} - {half}) as bigint)"
    pair = feistel(key, f"concat({tweak}, {n}, '.')", f"substring({digits}, 1, {half})", f"substring({digits}, {half} + 1)", high, low)
    return f"transform(array({pair}), q -> concat(lpad(q.l, {half}, '0'), lpad(q.r, {n} - {half}, '0')))[0]"


def luhn_sum(digits: str) -> str:
    """SQL: Luhn's sum of a digit string, the last digit counted once."""
    d = "cast(substring({0}, length({0}) - i, 1) as int)".format(digits)
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _refilled(form: str, digits: str) -> str:
    """SQL: the form with its last digits replaced, in order, by those given."""
    keep = f"length(regexp_replace({form}, '[^0-9]', '')) - length({digits})"
    step = f"if(ch rlike '[0-9]', named_struct('out', concat(a.out, if(a.n < {keep}, ch, substring({digits}, a.n - ({keep}) + 1, 1))), 'n', a.n + 1), named_struct('out', concat(a.out, ch), 'n', a.n))"
    return f"aggregate(split({form}, ''), named_struct('out', '', 'n', 0), (a, ch) -> {step}, a -> a.out)"


def _steps(key: str) -> list[str]:
    """Bodies of lambdas over v, the value before: matched text, its kind if valid, its number, its pseudonym."""
    kinds = "case " + " ".join(f"when v rlike {runtime.quoted(f'^(?:{p})$')} then '{k}'" for k, p in FORMS.items()) + " end"
    digits = "regexp_replace(v.m, '[^0-9]', '')"
    month_first = "try_to_date(if(v.m like '__/__/____' and try_to_date(v.m, 'dd/MM/yyyy') is null, v.m, null), 'MM/dd/yyyy')"
    day = f"coalesce(try_to_date(v.m, 'yyyy-MM-dd'), try_to_date(v.m, 'dd.MM.yyyy'), try_to_date(v.m, 'dd/MM/yyyy'), {month_first})"
    area, group, serial = (f"cast(substring({digits}, {a}, {n}) as bigint)" for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = f"""case v.kind when 'email' then true when 'address' then true when 'date' then {day} is not null
        when 'phone' then length({digits}) between 8 and 15
        when 'ssn' then {area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0
        when 'card' then {luhn_sum(digits)} % 10 = 0 and {digits} not rlike '^0+$' else false end"""
    octet = lambda i: f"cast(split(v.m, '[.]')[{i}] as bigint)"
    number = f"""named_struct('m', v.m, 'kind', v.kind, 'digits',
        case v.kind when 'card' then substring({digits}, 1, length({digits}) - 1)
             when 'phone' then case when {digits} rlike '^1?[0-9]{{10}}$' and (v.m not like '+%' or {digits} like '1__________') then right({digits}, 10) else right({digits}, least(10, length({digits}) - 3)) end else '' end,
        'place', case when v.kind = 'phone' and {digits} rlike '^1?[0-9]{{10}}$' and (v.m not like '+%' or {digits} like '1__________') then 'home' when v.kind = 'date' and {month_first} is not null then if(day({day}) <= 28, 'early', if(month({day}) = 2, 'leap', 'late')) else '' end, 'day', if(v.kind = 'date', {day}, null), 'pair',
        case v.kind when 'address' then named_struct('l', {octet(0)} * 256 + {octet(1)}, 'r', {octet(2)} * 256 + {octet(3)})
             when 'ssn' then named_struct('l', ({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1, 'r', {serial} - 1)
             when 'date' then case
                 when {month_first} is null then named_struct('l', cast(datediff({day}, date'1900-01-01') div 4297 as bigint), 'r', cast(datediff({day}, date'1900-01-01') % 4297 as bigint))
                 when day({day}) <= 28 then named_struct('l', (year({day}) - 1900) * 12L + month({day}) - 1, 'r', day({day}) - 13L)
                 when month({day}) = 2 then named_struct('l', (year({day}) - 1904) div 4 div 7, 'r', (year({day}) - 1904) div 4 % 7L)
                 else named_struct('l', (year({day}) - 1900) div 10, 'r', (year({day}) - 1900) % 10L) end end)"""
    area_of = "cast(substring(v.digits, 1, 3) as bigint)"
    home = feistel(key, f"if({area_of} >= 200, 'home', 'low')", f"{area_of} - if({area_of} >= 200, 200, 0)", "cast(substring(v.digits, 4) as bigint)", f"if({area_of} >= 200, 800L, 200L)", "10000000L")
    permuted = f"""named_struct('m', v.m, 'kind', v.kind, 'place', v.place, 'day', v.day, 'digits', case when v.place = 'home' then transform(array({home}), q -> concat(lpad(q.l + if({area_of} >= 200, 200, 0), 3, '0'), lpad(q.r, 7, '0')))[0]
            when v.kind in ('card', 'phone') then {_digits(key, "v.kind", "v.digits")} else '' end, 'pair',
        case v.kind when 'address' then {feistel(key, "'address'", "v.pair.l", "v.pair.r", "65536", "65536")}
             when 'ssn' then {feistel(key, "'ssn'", "v.pair.l", "v.pair.r", "88902", "9999")}
             when 'date' then case v.place when 'early' then {feistel(key, "'early'", "v.pair.l", "v.pair.r", "2400", "16")} when 'leap' then {feistel(key, "'leap'", "v.pair.l", "v.pair.r", "7", "7")}
                 when 'late' then {feistel(key, "concat('late', date_format(v.day, 'MMdd'))", "v.pair.l", "v.pair.r", "20", "10")} else {feistel(key, "'date'", "v.pair.l", "v.pair.r", "17", "4297")} end end)"""
    group_of = "(v.pair.l div 99 + 1)"
    whole = "date_add(date'1900-01-01', cast(v.pair.l * 4297 + v.pair.r as int))"
    check = luhn_sum("concat(v.digits, '0')")
    written = f"""named_struct('m', v.m, 'kind', v.kind, 'new', case v.kind
        when 'email' then concat('u', substring(sha2(concat_ws('|', {key}, 'email', lower(v.m)), 256), 1, 16), '@example.invalid')
        when 'card' then {_refilled("v.m", f"concat(v.digits, pmod(10 - {check} % 10, 10))")}
        when 'phone' then {_refilled("v.m", "v.digits")}
        when 'address' then concat_ws('.', v.pair.l div 256, v.pair.l % 256, v.pair.r div 256, v.pair.r % 256)
        when 'ssn' then concat_ws('-', lpad({group_of} + if({group_of} >= 666, 1, 0), 3, '0'), lpad(v.pair.l % 99 + 1, 2, '0'), lpad(v.pair.r + 1, 4, '0'))
        when 'date' then case when v.place = 'early' then concat_ws('/', lpad(v.pair.l % 12 + 1, 2, '0'), lpad(v.pair.r + 13, 2, '0'), 1900 + v.pair.l div 12)
            when v.place = 'leap' then concat('02/29/', 1904 + 4 * (v.pair.l * 7 + v.pair.r)) when v.place = 'late' then concat(substring(v.m, 1, 6), 1900 + v.pair.l * 10 + v.pair.r)
            when v.m like '____-%' then date_format({whole}, 'yyyy-MM-dd') when v.m like '%.%' then date_format({whole}, 'dd.MM.yyyy') else date_format({whole}, 'dd/MM/yyyy') end
        else v.m end)"""
    return [f"named_struct('m', v, 'kind', {kinds})", f"named_struct('m', v.m, 'kind', if({valid}, v.kind, null))", number, permuted, written]


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id column, the columns of keep, text with pseudonyms, and found: an array of (start, kind, was, now).

    key: the secret of the permutation; whoever has it can link and invert pseudonyms. Places are code points of the
    text as it was.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    any_form = runtime.quoted(ANY)
    rows = df.select(*map(runtime.column, kept), runtime.column(text_col)).toDF(*(f"in_{i}" for i in range(len(kept))), "doc")
    value = "v_"
    for step in _steps(runtime.quoted(key)):
        value = f"transform({value}, v -> {step})"
    new = "concat(array_join(zip_with(slice(g_, 1, size(f_)), p_, (g, v) -> concat(g, v.new)), ''), element_at(g_, -1))"
    found = "filter(zip_with(s_, p_, (s, v) -> named_struct('start', s, 'kind', v.kind, 'was', v.m, 'now', v.new)), x -> x.kind is not null)"
    both = spans.let(spans.starts("f_", "g_"), "s_", spans.let(value.replace("v_", "f_"), "p_", f"named_struct('text', {new}, 'found', {found})"))
    nothing = "named_struct('text', doc, 'found', cast(array() as array<struct<start:int,kind:string,was:string,now:string>>))"
    matches = f"if(doc rlike '[0-9@]', regexp_extract_all(doc, {any_form}, 0), cast(array() as array<string>))"
    made = spans.let(matches, "f_", f"if(coalesce(size(f_), 0) <= 0, {nothing}, {spans.let(f'split(doc, {any_form}, -1)', 'g_', both)})")
    rows = rows.withColumn("made", F.expr(made))
    return rows.select(*rows.columns[: len(kept)], "made.text", "made.found").toDF(*kept, "text", "found")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with pseudonyms, and how many of each kind it has."""
    rows = pseudonymise(runtime.table(spark, sf_dir, "documents", "doc_id", "text"), key="set by the operator")
    return rows.select("doc_id", "text", *(F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in FORMS))
