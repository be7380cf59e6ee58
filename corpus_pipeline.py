"""The corpus pipeline: from documents to token ids in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next;
all but the last return the columns of documents. Nulls in any column, empty texts, repeated rows and ids, and empty
tables go through as each operator defines them; further columns are carried along, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontam, jaccard, quality, runtime, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from the labels of these documents, but for the held-out part."""
    model = quality.train(docs, runtime.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more): the one with the smallest id.

    SimHash links fingerprints within two bits by op10_simhash's own code, and every pair is verified exactly. Pairs at this similarity
    that differ in more bits are found by minima of hash functions in bands; the README has the figures.
    """
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark's items."""
    return decontam.clean(docs, runtime.table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    length = F.coalesce(F.length("text").cast(clean.schema["n_chars"].dataType), "n_chars")
    return clean.select(*(length.alias(c) if c == "n_chars" else runtime.column(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with digests that show that they decode to it."""
    return bpe.round_trip(docs, bpe.rank_file(), with_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]

#: SQL can express neither the learned classifier nor the groups' transitive closure; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages rows go through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.written(docs, f"pipeline-{k}")
    return docs
