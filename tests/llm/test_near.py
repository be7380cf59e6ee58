"""The pipeline's near-dedup goes by SimHash; bands add what fingerprints cannot reach."""

import random

import corpus_pipeline
from tests.llm import test_jaccard
from tideline.llm import jaccard, simhash


def test_simhash_drops_near_copies_without_bands(spark, monkeypatch):
    """With no band as a key, exactly the similar texts whose fingerprints are linked are dropped."""
    rnd, texts = random.Random(7), []
    for _ in range(30):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
        other = list(base)
        other[rnd.randrange(3000)] = "new"
        texts += [" ".join(base), " ".join(other), " ".join(base[:1500])]
    texts += ["", None, "one two"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    prints = [simhash.majority(jaccard.shingles((t or "").encode())) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = (test_jaccard.brute_set(texts[k]) for k in (i, j))
            if a == b or (prints[i] ^ prints[j]).bit_count() <= jaccard.RADIUS and 5 * len(a & b) >= 4 * len(a | b):
                root[i] = min(root[i], root[j])
    monkeypatch.setattr(jaccard, "keys_of_bands", lambda nodes: nodes.limit(0).selectExpr("fp", "n", "fp as key"))
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, r in enumerate(root) if i == r} and len(kept) < len(texts) - 15
    monkeypatch.undo()
    whole = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").select("doc_id").collect()}
    assert whole == set(test_jaccard.brute_groups(list(enumerate(texts))).values()) <= kept
