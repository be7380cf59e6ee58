import random
import re
from fractions import Fraction
from itertools import permutations

from tideline.llm import audit


def masks(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "") + ("E" if d is not None and d > first[t] else "")
        yield lang or "", m, d in good, d in toxic


def brute(docs, labels):
    rows = list(masks(docs, labels))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == f for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def data(n=300):
    rnd = random.Random(4)
    docs = []
    for i in range(n):
        words = [rnd.choice(["one", "Two", "three", "FOUR", "a#b", "é", "\x0b", "x"]) if rnd.random() < 0.5 else f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 150, 250, 400]))]
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(words), rnd.choice(["en", "de", None, ""])))
    docs += [(1000 + i, "same text", "en") for i in range(n // 3)] + [(2, "same text", "fr"), (2, "same text", "fr"), (None, "same text", "en"), (None, docs[3][1], "de"), (3, docs[3][1], "de"), (4, None, "xx"), (5, "", "xx"), (6, "word " * 50_000, "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, n + 20, 2)] + [(1001, 1, 1), (2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, lang string, n int, good string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_all_orders_played_out(spark):
    docs, labels = data()
    got = audit.interactions(audit.mask_counts(audit.slim(*frames(spark, docs, labels)))).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)
    assert len(got) == 600 * len({x[2] or "" for x in docs})


def test_empty_tables(spark):
    d, labels = frames(spark, *data(5))
    assert audit.interactions(audit.mask_counts(audit.slim(d.limit(0), labels))).count() == 0
    assert audit.interactions(audit.mask_counts(audit.slim(d, labels.limit(0)))).agg({"good_lost": "max"}).first()[0] == 0


def test_polynomial_and_exact_integrals(spark):
    """The coefficients give the removed share at any point, and the values are the integrals of the derivatives."""
    rnd = random.Random(9)
    n = {m: rnd.randrange(1, 50) for m in range(32)}
    counts = spark.createDataFrame([("p", m, c, 0, 0) for m, c in n.items()], "part string, mask int, n long, good long, toxic long")
    poly = {r.term: r.n for r in audit.polynomial(counts).collect()}
    x = [Fraction(rnd.randrange(7), 6) for _ in range(5)]
    prod = lambda values: __import__("math").prod(values, start=Fraction(1))
    assert sum(c * prod(x[i] for i in audit._bits(t)) for t, c in poly.items()) == sum(c * (1 - prod(1 - x[i] for i in audit._bits(m))) for m, c in n.items())
    want = {i: sum(Fraction(c, len(audit._bits(m))) for m, c in n.items() if m >> i & 1) for i in range(5)}
    assert {r.filter: Fraction(r.shapley, 120) for r in audit.shapley(audit.polynomial(counts)).collect()} == want
