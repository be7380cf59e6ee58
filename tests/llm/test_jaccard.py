import random

import corpus_pipeline
from tideline.llm import jaccard

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(items):
    """Per id the smallest id of its group; ids are distinct."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [brute_set(t) for _, t in items]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(items):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(items)}


def changed(rnd, text, n):
    words = text.split()
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"new{rnd.random()}"
    return " ".join(words)


def test_stage_drops_texts_of_similarity_four_fifths(spark):
    rnd = random.Random(1)
    texts = [None, "", "one two", "One  two", "one three"]
    for _ in range(60):
        base = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([60, 200, 400])))
        texts += [base, changed(rnd, base, len(base.split()) // 70 or 1), changed(rnd, base, len(base.split()) // 40), changed(rnd, base, len(base.split()) // 8)]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    want = brute_groups(list(enumerate(texts)))
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).select("doc_id").collect())
    assert kept == sorted(set(want.values())) and len(kept) < len(texts) - 60
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), SF).count() == 0


def test_crowded_keys_lose_no_link(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for n in (1, 3, 6, 9, 12, 20):
        texts += [changed(rnd, " ".join(base), n) for _ in range(25)]
    texts += [changed(rnd, t, 2) for t in texts[-50:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(list(enumerate(texts)))
    got = {r.doc_id for r in jaccard.one_of_each(docs, group=40).select("doc_id").collect()}
    assert got == set(want.values()) and 1 < len(got) < len(texts)


def test_products_count_as_sets_do():
    import numpy as np

    rnd = random.Random(3)
    sets = [set(rnd.sample(range(40), rnd.randint(1, 40))) for _ in range(60)] + [set(range(30)), set(range(31)), set(range(5000)), set(range(5600))]
    i, j = jaccard.similar([np.array(sorted(s), np.uint64) for s in sets])
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_sketches_rule_no_link_out():
    """Of pairs at a similarity of 0.8 or a little more, the sketches differ in no more than APART places."""
    import numpy as np

    rnd = np.random.Generator(np.random.PCG64(4))
    apart = []
    for _ in range(400):
        x = rnd.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = (jaccard.sketch(jaccard.minima(np.sort(s))) for s in (x[:900], x[100:]))
        y = (a ^ b).view(np.uint64)
        apart.append(sum((v >> 4 * k & 15) != 0 for v in y.tolist() for k in range(16)))
    assert max(apart) <= jaccard.APART and 20 <= np.mean(apart) <= 25
