import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tideline.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KNOWN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")
HEX_ALPHABET, BASE32_ALPHABET = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def p_value(token):
    s = "".join(c for c in token if c.isalnum())
    if all(c in HEX_ALPHABET for c in s) or all(c in HEX_ALPHABET.upper() for c in s):
        alphabet, s = HEX_ALPHABET, s.lower()
    elif all(c in BASE32_ALPHABET for c in s):
        alphabet = BASE32_ALPHABET
    elif s == s.lower() or s == s.upper():
        alphabet, s = "abcdefghijklmnopqrstuvwxyz0123456789", s.lower()
    else:
        alphabet = BASE62_ALPHABET
    kind = lambda c: "digit" if c.isdigit() else "upper" if c.isupper() else "lower"
    code = lambda c: 0 if c.isdigit() else 1 if c in "aeiouAEIOU" else -1
    k, m = len(alphabet), len(s)
    df = k - 1
    chi = sum((s.count(a) - m / k) ** 2 / (m / k) for a in alphabet)
    z = [((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))]
    share = [sum(kind(a) == c for a in alphabet) / k for c in ("digit", "upper", "lower")]
    q2, q3 = sum(p**2 for p in share), sum(p**3 for p in share)
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    z.append(((m - 1) * (1 - q2) - changes) / math.sqrt((m - 1) * q2 * (1 - q2) + 2 * (m - 2) * (q3 - q2**2)))
    mean, square = (sum(f(code(a)) for a in alphabet) / k for f in (lambda x: x, lambda x: x * x))
    together = sum(code(a) * code(b) for a, b in zip(s, s[1:]))
    z.append(((m - 1) * mean**2 - together) / math.sqrt((m - 1) * (square**2 - mean**4) + 2 * (m - 2) * (mean**2 * square - mean**4)))
    whole = (z[0] + 2 * z[1] + 2 * z[2]) / 3
    return 0.5 * math.erfc(-(whole - (0.9 * math.sqrt(m) - 0.9)) / 1.05 / math.sqrt(2))


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    blank = KNOWN.sub(lambda m: " " * len(m[0]), text)
    tokens = [m for m in TOKEN.finditer(blank) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and sum(c.isalnum() for c in m[0]) >= 12]
    weights = [min(len(m[0]), 64) for m in tokens]
    q = [p_value(m[0]) / (w * len(tokens) / sum(weights)) for m, w in zip(tokens, weights)]
    line = max((v for i, v in enumerate(sorted(q)) if v <= 0.01 * (i + 1) / len(q)), default=-1.0)
    base += [(m.start(), 3, "random", m.end()) for m, v in zip(tokens, q) if v <= line]
    return sorted(base)


def texts():
    rnd = random.Random(4)
    of = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    some = [None, "", 'x token = "abc123" y', "Password:short", "password: token=abcdef", "secret=token: abcdefgh", "é\U0001f600 api_key: 'zzzzzz' AKIA" + "Z" * 16, "AKIA" + "Q" * 15, "f" * 23 + " " + "f" * 24, "APIKEY=" + "a" * 30]
    pool = [lambda: of(BASE62_ALPHABET + "+/", rnd.randint(20, 90)), lambda: of(HEX_ALPHABET, rnd.randint(20, 60)).upper(), lambda: of("ab1", 40), lambda: "the-quick-brown-fox-jumps-over-2", lambda: "-".join(of(HEX_ALPHABET, n) for n in (8, 4, 4, 4, 12)), lambda: "getUserAccountById2AndName", lambda: "a-_/+-_/+-_/+-_/+-_/+1", lambda: of(BASE32_ALPHABET, 32), lambda: "token = " + of(HEX_ALPHABET, 40), lambda: "word" * 6, lambda: "é ü", lambda: "a1" * 12 + "=="]
    return some + [" ".join(rnd.choice(pool)() for _ in range(rnd.randint(1, 9))) for _ in range(150)] + ["long text " * 12000 + "token: 0123456789"]


def test_rows_against_brute_force(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(all_texts)], "doc_id long, text string, found int")
    got = {r.doc_id: [(x.start, x["rank"], x.kind, x.end) for x in r.found] for r in secrets.find(df).collect()}
    assert len(got) == len(all_texts)
    for i, t in enumerate(all_texts):
        assert got[i] == brute(t), t
    assert any(x[2] == "random" for v in got.values() for x in v)
    assert secrets.find(df.limit(0)).count() == 0


def test_digest_and_ties(spark):
    text = 'token = "0123456789abcdef01234567"'
    df = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    rows = secrets.find(df).select(F.expr(secrets.listed("found")).alias("s"), F.expr(f"sha2({secrets.listed('found', 'x.rank < 3')}, 256)").alias("h")).collect()
    assert [r.s for r in rows] == ["assign:0:33,hex:9:33"] * 2 and rows[0].h == hashlib.sha256(b"assign:0:33,hex:9:33").hexdigest()


def test_redaction(spark):
    rows = [(1, 'a é token = "0123456789abcdef01234567" b secret: zzzzzzz', "x"), (2, None, "y"), (3, "clean", None), (3, "clean", None), (4, "AKIA" + "Q" * 16, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(map(tuple, secrets.redact(df).collect()), key=str)
    assert got == sorted([(1, 'a é [secret]" b [secret]', "x"), (2, None, "y"), (3, "clean", None), (3, "clean", None), (4, "[secret]", "")], key=str)


def test_the_sql_agrees_on_texts_with_random_tokens():
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts())))
    got = {r[0]: r[6] for r in con.execute(f"select doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans from ({secrets.SQL})").fetchall()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(t)) for i, t in enumerate(texts())}


def found_in(spark, tokens):
    """The share of texts of one token each whose token is found."""
    rows = secrets.find(spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string"))
    return rows.filter("size(found) > 0").count() / len(tokens)


def test_recall_on_keys_and_false_alarms_on_ordinary_tokens(spark):
    rnd = random.Random(6)
    of = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    some = lambda make: [t for t in (make() for _ in range(1500)) if len(t) >= 20 and re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
    lengths = (20, 24, 28, 32, 40, 48, 64)
    keys = {
        "uuid": some(lambda: "-".join(of(HEX_ALPHABET, n) for n in (8, 4, 4, 4, 12))),
        "base 64": some(lambda: of(BASE62_ALPHABET + "+/", rnd.choice(lengths))),
        "base 64 for addresses": some(lambda: of(BASE62_ALPHABET + "-_", rnd.choice(lengths))),
        "base 36": some(lambda: of("abcdefghijklmnopqrstuvwxyz0123456789", rnd.choice(lengths))),
        "base 32": some(lambda: of(BASE32_ALPHABET, rnd.choice(lengths))),
        "upper hexadecimal": some(lambda: of(HEX_ALPHABET.upper(), rnd.choice(lengths))),
    }
    words = "account adapter address amount archive balance batch binary branch buffer bundle button cache calendar canvas capture category channel charge checksum client cluster collect column command commit compile compress config connect console container context convert counter create cursor customer database default delete deploy detail device dialog digest directory display document domain driver dynamic editor element encode engine entity error event example execute export factory feature fetch field filter folder format frame function gateway generate graph group handle header helper history image import index input insert instance invoice item journal kernel label language layout length library license limit listener locale logger manager mapper market matrix measure member memory merge message metric migrate model module monitor network normal notify number object option order output package packet parameter parent parse partition password payload payment percent permission picture pipeline player policy position prefix preview process product profile project property provider proxy publish queue random range reader record region register release remote render replace report request resource response result return review rotate router sample schema scroll search section select sender sequence server service session setting shadow shipping signal simple source stream string style subject submit summary support switch symbol system table target template thread ticket timer token toolbar track transfer transform update upload user validate value vector vendor version video virtual visible volume warning widget window worker writer".split()
    number = lambda: str(rnd.choice((rnd.randrange(10), rnd.randrange(100), rnd.randrange(1990, 2030))))

    def parts():
        found = [rnd.choice(words) for _ in range(rnd.randint(2, 6))]
        found.insert(rnd.randint(1, len(found)), number())
        return found

    ordinary = {
        "camel": some(lambda: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(parts()))),
        "pascal": some(lambda: "".join(map(str.capitalize, parts()))),
        "snake": some(lambda: "_".join(parts())),
        "constant": some(lambda: "_".join(parts()).upper()),
        "slug": some(lambda: "-".join(parts())),
        "path": some(lambda: "/" + "/".join(parts())),
    }
    recall = {k: found_in(spark, v) for k, v in keys.items()}
    alarms = {k: found_in(spark, v) for k, v in ordinary.items()}
    assert min(recall.values()) >= 0.9, recall
    assert max(alarms.values()) <= 0.01, alarms


def test_a_long_key_among_many_ordinary_tokens_is_found(spark):
    rnd = random.Random(7)
    ordinary = " ".join(f"/srv/data/reports/summary_{2000 + i}/index" for i in range(20))
    texts = [f"{ordinary} {''.join(rnd.choice(BASE62_ALPHABET) for _ in range(64))}" for _ in range(200)]
    rows = secrets.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sum(any(x["start"] == len(ordinary) + 1 for x in r.found) for r in rows) >= 195
    assert all(len(r.found) <= 1 for r in rows)


def test_texts_that_are_all_tokens_take_seconds(spark):
    import time

    many = [" ".join("%024x" % (i * 7919 + 10**20) for i in range(40_000)), " ".join("token=%06d" % i for i in range(80_000)), "a1" * 500_000, "token" * 200_000, " ".join("Ab%dxYz-%d-%d-q" % (i, i * i, i) for i in range(40_000))]
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(5)
    start = time.time()
    rows = {r.doc_id: r.n for r in secrets.find(df).select("doc_id", F.size("found").alias("n")).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.time() - start < 60
    assert rows[0] == 40_000 and rows[1] == 80_000 and clean[0] == " ".join(["[secret]"] * 40_000) and clean[1] == " ".join(["[secret]"] * 80_000)
