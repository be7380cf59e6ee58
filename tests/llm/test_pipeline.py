import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tideline.llm import bpe, quality
from tests.llm import test_decontam, test_jaccard, test_secrets

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted(map(tuple, docs.collect()))
    steps, at = {}, docs
    for name, f in corpus_pipeline.STAGES:
        at = f(spark, at, SF)
        steps[name] = at = spark.createDataFrame(at.collect(), at.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    kept = lambda name: sorted(map(tuple, steps[name].collect()))
    # quality: the same rows fitted and scored by the plain model
    import zlib

    known = sorted((r[0], r[1]) for r in rows if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 4 != 2)
    model = quality.fit(np.array([quality.features(t.encode()) for _, t in known]), np.array([labels[d] for d, _ in known], float))
    rows = [r for r, p in zip(rows, model.score(np.array([quality.features(r[1].encode()) for r in rows]))) if p >= 0.7]
    assert kept("quality classifier") == rows
    groups = test_jaccard.brute_groups([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if groups[r[0]] == r[0]]
    assert kept("simhash near-dedup") == rows
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = [w for _, w in sorted((d, w) for d, w, *_ in [(i, test_decontam.decontam.words_of(t.encode())) for i, t in bench])]
    grams = {tuple(w[i : i + 10]) for w in words for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + 10]) in grams for w in [test_decontam.decontam.words_of(t.encode())] for i in range(len(w)))
    rows = [r for r in rows if not hit(r[1])]
    assert kept("benchmark decontamination") == rows

    def redacted(text):
        out, end = "", 0
        for start, _, _, stop in test_secrets.brute(text):
            if start > end or not out and start >= end:
                out += text[end:start] + "[secret]"
            end = max(end, stop)
        return out + text[end:]

    rows = [(d, t, lang, source, len(t)) for d, old, lang, source, _ in rows for t in (redacted(old),)]
    assert kept("secret scans") == rows
    coder = bpe.coder(bpe.rank_file())
    got = {r.doc_id: r for r in steps["byte-level BPE"].collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        assert coder.decode(got[r[0]].ids) == r[1].encode() and got[r[0]].decoded_sha256 == hashlib.sha256(r[1].encode()).hexdigest()


def test_odd_rows_go_through(spark):
    """Nulls, empty texts, repeated rows and ids, and further columns whose names and types are awkward."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text, None, None, None), (None, text + " more", "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0), (7, "other words entirely, for once", "en", "s", 3), (7, text, "en", "s", 2)]
    more = "fp string, score double, predicted int, _hit string, `a.b` int, id string, `text ` string, m map<string,int>, row struct<`x.y`:int>, in_0 string, found int, kind int"
    fields = "doc_id long, text string, lang string, source string, n_chars long, "
    docs = spark.createDataFrame([(*r, "x", 0.5, 1, "h", 3, "i", "t", {"k": 1}, (4,), "in", 2, 7) for r in rows], fields + more)
    one = corpus_pipeline.drop_copies(spark, docs, SF)
    assert one.schema.names == docs.schema.names
    # the null and the empty text are one group, of which the row with an id stays; row 7's copy of the text goes with row 1's group
    got = sorted(map(tuple, one.select("doc_id", "text", "n_chars", "`a.b`", "m").collect()))
    assert got == [(1, text, 9, 3, {"k": 1}), (5, "", 0, 3, {"k": 1}), (7, "other words entirely, for once", 3, 3, {"k": 1})]
    at = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        each = f(spark, docs, SF)
        assert each.schema.names == docs.schema.names and [x.dataType for x in each.schema] == [x.dataType for x in docs.schema], name
        assert each.count() <= len(rows) and f(spark, docs.limit(0), SF).count() == 0
        at = f(spark, at, SF)
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows) and corpus_pipeline.encode(spark, at, SF).count() == at.count()


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
