import datetime
import hashlib
import random
import re

import pytest

from tideline.llm import pii

KEY = "k'\\1"


def h(tweak, i, value, modulus):
    return int(hashlib.sha256(f"{KEY}|{tweak}{i}|{value}".encode()).hexdigest()[:15], 16) % modulus


def network(tweak, left, right, high, low):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + h(tweak, i, right, high)) % high
        else:
            right = (right + h(tweak, i, left, low)) % low
    return left, right


def digits(tweak, d):
    half = len(d) // 2
    a, b = network(f"{tweak}{len(d)}.", int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))


def refill(form, d):
    n, out = len(re.sub("[^0-9]", "", form)) - len(d), ""
    for c in form:
        if c.isdigit():
            out, n = out + (c if n > 0 else d[-n]), n - 1
        else:
            out += c
    return out


def brute(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if kind == "card":
        body = digits("card", d[:-1])
        return refill(m, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        if len(d) == 10 and m[0] != "+" or len(d) == 11 and d[0] == "1":
            area, rest = int(d[-10:-7]), int(d[-7:])
            low = area < 200
            x, y = network("low" if low else "home", area - 200 * (not low), rest, 200 if low else 800, 10**7)
            return refill(m, f"{x + 200 * (not low):03d}{y:07d}")
        return refill(m, digits("phone", d[-min(10, len(d) - 3) :]))
    if kind == "address":
        a, b, c, e = map(int, m.split("."))
        x, y = network("address", a * 256 + b, c * 256 + e, 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        a, b, c = map(int, m.split("-"))
        x, y = network("ssn", (a - 1 - (a > 666)) * 99 + b - 1, c - 1, 88902, 9999)
        area = x // 99 + 1
        return f"{area + (area >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if "/" in m and int(m[3:5]) > 12:
        month, day, year = map(int, m.split("/"))
        if day <= 28:
            x, y = network("early", (year - 1900) * 12 + month - 1, day - 13, 2400, 16)
            return f"{x % 12 + 1:02d}/{y + 13}/{1900 + x // 12}"
        if month == 2:
            x, y = network("leap", *divmod((year - 1904) // 4, 7), 7, 7)
            return f"02/29/{1904 + 4 * (7 * x + y)}"
        x, y = network(f"late{month:02d}{day}", *divmod(year - 1900, 10), 20, 10)
        return f"{m[:6]}{1900 + 10 * x + y}"
    form = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if "." in m else "%d/%m/%Y"
    n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
    x, y = network("date", *divmod(n, 4297), 17, 4297)
    return (datetime.date(1900, 1, 1) + datetime.timedelta(x * 4297 + y)).strftime(form)


CASES = [
    ("email", "that.92@mail2.example.com"), ("card", "4670349892180623"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (743) 555-3824"), ("phone", "(212) 555-0100"),
    ("address", "152.143.123.131"), ("address", "8.8.8.8"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("date", "1999-12-31"), ("date", "29.02.2000"), ("date", "01/03/2024"),
    ("date", "12/25/1990"), ("date", "02/29/1996"), ("date", "10/31/1999"), ("phone", "1-555-234-5678"), ("phone", "555-234-5678"), ("phone", "123-234-5678"), ("phone", "+49 30 1234567"), ("phone", "+1 555 234 5678"),
]
LEFT = ["31/31/2000", "13/13/2000", "02/30/2000", "4670349892180624", "6844976499621582", "2023-02-30", "000-12-3456", "256.1.1.1", "1.2.3.4.5", "v1.2.3", "12345", "666-12-3456", "a@b", "0000000000000000"]


def test_values_and_places(spark):
    rows = [(i, f"é x {m}, y {m}.") for i, (_, m) in enumerate(CASES)] + [(100 + i, f"q {m} z") for i, m in enumerate(LEFT)] + [(200, None), (201, ""), (None, "no"), (202, "w " * 60000 + CASES[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    assert len(got) == len(rows)
    for i, (kind, m) in enumerate(CASES):
        new = brute(kind, m)
        assert got[i].text == f"é x {new}, y {new}.", (kind, m)
        assert [tuple(x) for x in got[i].found] == [(4, kind, m, new), (4 + len(m) + 4, kind, m, new)]
        assert new != m
        if kind == "card":
            assert luhn(re.sub("[^0-9]", "", new)) % 10 == 0
    for i, m in enumerate(LEFT):
        assert got[100 + i].text == f"q {m} z" and not got[100 + i].found, m
    assert got[200].text is None and got[201].text == "" and got[None].text == "no"
    assert got[202].text.endswith("@example.invalid") and got[202].found[0].start == 120000
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_values_side_by_side(spark):
    """One value right behind another hides neither."""
    values = ["4465758382889437", "+1 (743) 555-3824", "8.8.8.8", "4539 1488 0343 6467", "2001-02-03", "123-45-6789", "a.b@c.example.com", "(212) 555-0100"]
    kinds = ["card", "phone", "address", "card", "date", "ssn", "email", "phone"]
    pairs = [(a, b) for a in range(len(values)) for b in range(len(values))]
    df = spark.createDataFrame([(i, f"x {values[a]} {values[b]} y") for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == f"x {brute(kinds[a], values[a])} {brute(kinds[b], values[b])} y", (values[a], values[b])


@pytest.mark.parametrize("high, low", [(17, 43), (5, 100)])
def test_a_permutation_of_the_domain(spark, high, low):
    pair = pii.feistel("'k'", "'t'", f"id div {low}", f"id % {low}", str(high), str(low))
    rows = spark.range(high * low).selectExpr(f"{pair} as q").collect()
    assert {(r.q.l, r.q.r) for r in rows} == {(a, b) for a in range(high) for b in range(low)}


def test_random_dates_and_numbers_stay_valid(spark):
    rnd = random.Random(7)
    some = [(datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73049))).isoformat() for _ in range(300)]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), KEY).collect()
    assert len({r.text for r in got}) == len(set(some))
    assert all(datetime.date.fromisoformat(r.text).year in range(1900, 2100) for r in got)


def test_forms_of_one_number_stay_linked(spark):
    forms = ["1-555-234-5678", "+1 555 234 5678", "555-234-5678", "(555) 234-5678", "+1 (555) 234-5678", "1 (555) 234-5678"]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string"), KEY).collect()
    numbers = {re.sub("[^0-9]", "", r.text)[-10:] for r in got}
    assert len(numbers) == 1 and "5552345678" not in numbers and numbers.pop()[0] >= "2"


def test_month_first_dates_are_permuted_among_themselves(spark):
    some = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)) for i in range(0, 73049, 7)]
    some = [d.strftime("%m/%d/%Y") for d in some if d.day > 12]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), KEY).collect()]
    assert len(set(got)) == len(some) and all(datetime.datetime.strptime(t, "%m/%d/%Y").day > 12 for t in got)


def test_texts_full_of_values_take_seconds(spark):
    import time

    text = " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(30_000))
    start = time.time()
    row = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "a@" * 300_000), (3, "1 " * 300_000), (4, "+" * 500_000)], "doc_id long, text string").repartition(4), KEY).filter("doc_id = 1").first()
    assert time.time() - start < 60 and len(row.found) == 30_000 and row.found[-1].start == text.rindex(" ") + 1
