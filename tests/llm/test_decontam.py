import random
import re

from tideline.llm import decontam


def brute(docs, bench, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            b = words(text)
            n = min(size, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        items.add(item)
        out.append((d, len(w), len(hit), sorted(map(str, items))))
    return sorted(out, key=str)


def data():
    rnd = random.Random(1)
    bench = [(1, None), (2, ""), (3, "One two THREE"), (4, "one-two three"), (11, "é a b c d e f g h i j k l"), (5, "é a b c d e f g h i j zz"), (5, "x y z " * 5)]
    docs = [(1, None), (2, ""), (2, ""), (None, "one, two; three one two"), (3, "xone two three"), (4, "q É é A b c d e f g h i j k l m"), (5, "x y z " * 9)]
    for k in range(30):
        docs.append((10 + k, " ".join(rnd.choice(["x", "y", "z", "one", "two", "three", "é a b c d e f g h i j", "."]) for _ in range(40))))
    return docs, bench


def test_rows_against_brute_force(spark):
    docs, bench = data()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (1 << 20, 40):  # one automaton; many, united
        got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in decontam.scan(d, b, block_bytes=limit).collect()], key=str)
        assert got == brute(docs, bench)
    assert decontam.scan(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.scan(d, b.limit(0)).collect()} == {0}


def test_offsets_point_into_the_original():
    text = "Say: ÉÉ one,  TWO (three)!".encode()
    found = decontam.Windows(((1, "one two three"),), 10).scan(text)
    assert found == (5, [(2, 5)], {1})
    (a, b), = decontam.offsets(text, found[1])
    assert text[a:b] == b"one,  TWO (three"


def generated(items, words, seed=7):
    rnd = random.Random(seed)
    vocabulary = [f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}" for _ in range(4000)]
    bench = [(i, " ".join(rnd.choices(vocabulary, k=words))) for i in range(items)]
    docs = []
    for d in range(150):
        parts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(200)))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(bench)[1].split()
            at = rnd.randrange(len(w) - 30)
            parts += [" ".join(w[at : at + rnd.choice([9, 10, 11, 25])]).upper(), rnd.choice(vocabulary)]
        docs.append((d, ", ".join(parts)))
    passage = " ".join(bench[0][1].split()[:20])
    docs += [(1000 + i, passage) for i in range(100)] + [(2000, " ".join(rnd.choices(vocabulary, k=100_000)) + " " + passage), (2001, bench[1][1] * 3), (2001, bench[1][1] * 3), (None, None)]
    return docs, [*bench, (0, bench[0][1]), (None, bench[2][1]), (9999, "one two"), (9998, "one"), (9997, "")]


def test_a_large_benchmark_meets_documents_by_anchors(spark):
    docs, bench = generated(300, 300)
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, row_key string").repartition(6)
    b = spark.createDataFrame(bench, "item_id long, text string").repartition(6)
    assert decontam.small_benchmark(b, "item_id", "text", 50_000) is None
    rows = lambda df: sorted(([str(r[c]) for c in ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "hit_words", "hit_bytes")] for r in df.collect()))
    whole = rows(decontam.scan(d, b, block_bytes=1 << 30))
    assert rows(decontam.scan(d, b, block_bytes=50_000)) == whole and rows(decontam.scan(d, b, block_bytes=1000)) == whole
    assert sum(r[2] != "0" for r in whole) > 150
    clean = [sorted(((r.doc_id, r.text or "", r.row_key) for r in decontam.clean(d, b, block_bytes=limit).collect()), key=str) for limit in (1 << 30, 50_000)]
    assert clean[0] == clean[1] and 0 < len(clean[0]) < len(docs)


def test_anchors_of_a_window_are_those_of_a_text_that_holds_it():
    rnd = random.Random(1)
    words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(400)]
    for size in range(1, 11):
        all_of = set(decontam.anchors(words, size).tolist())
        for at in range(0, len(words) - size, 7):
            assert set(decontam.anchors(words[at : at + size], size).tolist()) <= all_of
        assert len(decontam.anchors(words[:size], size)) == 1 and len(decontam.anchors(words[: size - 1], size)) == 0
