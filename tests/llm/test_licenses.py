import random
import re

from tideline.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = WORDS.findall(lower(text))
    at = sorted(i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    joined = " " + " ".join(w) + " "
    base = {x for p, x in licenses.PHRASES.items() if f" {p} " in joined}
    more = {x for x, t in licenses.without_leading_gaps(licenses.TEMPLATES) if re.search(licenses._regex(licenses.parse(t)) + " ", joined)}
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if at else 0.0


def test_template_regions():
    a = licenses.Automaton([("x", "a [[b {{2}} c]] d"), ("y", "a {{1}} e")])
    words = lambda s: [w.encode() for w in s.split()]
    assert a.scan(words("a d")) == [(0, 2, "x")]
    assert a.scan(words("q a b z z c d")) == [(1, 7, "x")]
    assert a.scan(words("a b z z z c d")) == []
    assert a.scan(words("a b c d a q e a e")) == [(0, 4, "x"), (4, 7, "y"), (7, 9, "y")]
    assert a.scan(words("a b d")) == []


def test_rows_against_brute_force(spark):
    rnd = random.Random(2)
    pool = ["MIT License", "mit", "license", "Apache License,", "Version 2.0", "Licensed under the", "Released under the", "GNU General Public License, version 3", "CC BY-NC 4.0.", "this work is", "é", "general public license", "\n"]
    texts = [None, "", "...", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."] + [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))) for _ in range(200)]
    texts += ["word " * 30000 + "Licensed under CC BY-NC 4.0.", next(t for x, t in licenses.TEMPLATES if x == "mit-text").replace("[[", "").replace("]]", "").replace("{{12}}", "the authors")]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted((brute(t) for t in texts), key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_notices_are_accepted_and_altered_ones_are_not():
    """Every template's own wording, with and without its optional parts, has its label; with a mandatory word changed it has not."""
    made = licenses.Automaton(licenses.TEMPLATES)

    def wording(items, full):
        for x in items:
            if isinstance(x, str):
                yield x.encode()
            elif x[0] == "optional":
                yield from wording(x[1], full) if full else ()
            elif full:
                yield from [b"somebody"] * x[1]

    for label, template in licenses.TEMPLATES:
        items = licenses.parse(template)
        for full in (True, False):
            words = list(wording(items, full))
            assert label in {x for _, _, x in made.scan(words)}, (label, full)
        mandatory = [i for i, x in enumerate(items) if isinstance(x, str)]
        words = [b"altered" if i == mandatory[len(mandatory) // 2] else x.encode() for i, x in enumerate(items) if isinstance(x, str)]
        assert label not in {x for _, _, x in made.scan(words)}, label
