import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import ngram


def brute(rows, share=ngram.FREQUENT):
    """rows: (id, text, train). None stands for the end, and as a history for the start."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    steps = lambda t: [(w[i - 2] if i > 1 else None, w[i - 1] if i else None, x, i) for w in [split(t)] for i, x in enumerate(w)]
    one, two, texts = Counter(), Counter(), 0
    for _, t, train in rows:
        if train:
            one.update(x for _, _, x, _ in steps(t))
            two.update((h, x) for _, h, x, _ in steps(t))
            texts += 1
    n, v = sum(one.values()), len(one)
    often = lambda x: x is None or one[x] * share >= n
    has_two = lambda g, h, i: i > 0 and often(g) and often(h)
    three = Counter((g, h, x) for _, t, train in rows if train for g, h, x, i in steps(t) if has_two(g, h, i))
    state = lambda h: texts if h is None else one[h]
    single, total = Counter(), Counter()
    for _, t, train in rows:
        if train:
            for g, h, x, i in steps(t):
                total[1, int(math.log2(state(h)))] += 1
                single[1, int(math.log2(state(h)))] += two[h, x] == 1
                if has_two(g, h, i):
                    total[2, int(math.log2(two[g, h]))] += 1
                    single[2, int(math.log2(two[g, h]))] += three[g, h, x] == 1
    share_of = lambda k, c: 1 - (single[k, int(math.log2(c))] + 1) / (total[k, int(math.log2(c))] + 2)
    out = []
    for d, t, train in rows:
        base = score = 0.0
        for g, h, x, i in steps(t):
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if state(h):
                a = share_of(1, state(h))
                p = a * two[h, x] / state(h) + (1 - a) * p
            if has_two(g, h, i) and two[g, h]:
                a = share_of(2, two[g, h])
                p = a * three[g, h, x] / two[g, h] + (1 - a) * p
            score += math.log10(p)
        out.append((d, not train, len(steps(t)), sum(one[x] > 0 for _, _, x, _ in steps(t)), n, base, score))
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert tuple(g)[:5] == w[:5] and tuple(g)[5:] == pytest.approx(w[5:], abs=2e-6)


def test_rows_against_brute_force(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n ", "One one ONE", "É é x\x1cy"] + [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) + rnd.choice(["", "\n"]) for _ in range(80)]
    rows = [(None if i == 7 else i + 1000, t, rnd.random() < 0.7) for i, t in enumerate(texts)] + [(1010, texts[10], True)] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, t boolean, score int").repartition(3)
    # one level; ranges that are merged in one, two and three levels of batches; few and all words in two-word states
    for share, more in ((1000, {}), (12, {"chunk": 50}), (1000, {"chunk": 50, "shard": 200, "bits": 2}), (12, {"chunk": 40, "shard": 20, "bits": 2}), (10**9, {"chunk": 60, "shard": 5, "bits": 1})):
        same(ngram.score(df, F.col("t"), frequent=share, **more).collect(), brute(rows, share))
    same(ngram.score(df, F.lit(False)).collect(), brute([(d, t, False) for d, t, _ in rows]))
    assert ngram.score(df.limit(0), F.col("t")).count() == 0


def test_states_sum_to_one():
    """From a state of two words, of one, and from the root, all words of a closed vocabulary and an unseen one."""
    import numpy as np

    counts = np.array([50, 30, 20])  # of words a, b, c; V = 3, N = 100; the text read so far is "a b"
    model = ngram.Automaton(100, 3, [1] * 128, [4] * 128)
    after_b, after_ab = np.array([25, 5, 0, 0]), np.array([7, 0, 0, 0])

    def step(word, pair, triple):
        return 10 ** model.walk(np.array([50, 30, word]), np.array([50, 12, pair]), np.array([-1, -1, triple]), np.array([0]), 60)[2]

    for two in (True, False):
        p = [step(w, x, y if two else -1) for w, x, y in zip([*counts, 0], after_b, after_ab)]
        a2, a1 = model.arc[1][3], model.arc[0][4]
        root = (np.array([*counts, 0]) + 0.5) / (100 + 0.5 * 4)
        one = a1 * after_b / 30 + (1 - a1) * root
        assert root.sum() == pytest.approx(1) and p == pytest.approx(a2 * after_ab / 12 + (1 - a2) * one if two else one)
        assert sum(p) == pytest.approx(a2 * 7 / 12 + 1 - a2 if two else 1)  # 7 of the state's 12 are followed by the three words


def test_failure_arcs_are_followed():
    import numpy as np

    model = ngram.Automaton(100, 3, [1] * 128, [4] * 128)
    levels = model.levels(np.array([50, 30, 20]), np.array([50, 12, 0]), np.array([-1, -1, 0]), np.array([0]), 60)
    (_, _, root, _), (one, arc_one, _, fail_one), (two, arc_two, _, fail_two) = levels
    assert two.tolist() == [False, False, True] and one.all() and not arc_two[2] and not arc_one[2]
    assert ngram._walked(levels)[2] == pytest.approx(fail_two[2] + fail_one[2] + root[2])


def test_rows_sent_grow_with_the_corpus(spark):
    """Rows for each chunk stay the same when there are four times as many chunks."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sent = []
    for some in (df, df.union(df).union(df).union(df)):
        held = ngram.chunks(some.coalesce(1), "doc_id", "text", F.lit(True), 100_000)
        n = held.count()
        sent.append(held.select("chunk", "sizes", "words", "numbers", "train").mapInArrow(ngram._ask(6, ngram.frequent_words(held, 1000)), ngram._ASKED).count() / n)
    assert sent[1] == pytest.approx(sent[0], rel=0.05) and sent[1] <= 3 * 64


def test_texts_of_many_slices(spark):
    """More text than one slice of a batch: no token is lost, and scores are those of the rows by themselves."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 4000).to_pylist()
    assert sum(len(d["text"]) for d in docs) > 2 * ngram.runtime.SLICE_BYTES
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(f"doc_id <= {max(d['doc_id'] for d in docs)}").coalesce(1)
    rows = [(d["doc_id"], d["text"], d["doc_id"] % 5 != 1) for d in docs]
    same(ngram.score(df, F.col("doc_id") % 5 != 1, chunk=700_000, shard=3_000, bits=6).collect(), brute(rows))
