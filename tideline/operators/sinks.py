"""Sinks: snapshots, retention, documents as text, and settings that are written only when they change."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import commits


def snapshot(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """All tables as Parquet folders under one path; a new snapshot replaces an old one of the same path."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/{name}")


def retained(df: DataFrame, at: Column, limit: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that go: strictly before the limit goes; rows without a time stay."""
    old = F.coalesce(at < limit, F.lit(False))
    return df.filter(~old), df.filter(old)


def purged(events: DataFrame, payloads: DataFrame, as_of: Column, key: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """Payloads that have not expired (at the limit they have), and events with references to the others nulled."""
    alive = payloads.filter(~F.coalesce(F.col("expires_at") <= as_of, F.lit(False)))
    known = alive.select(F.col(key).alias("_known")).distinct()
    kept = events.join(known, events[key] == known["_known"], "left").withColumn(key, F.col("_known")).drop("_known")
    return alive, kept


def documents_as_text(df: DataFrame, path: str, key: str, order: str, line: str) -> None:
    """One folder per document with its lines in order; documents are spread over tasks by key."""
    df.repartition(key).sortWithinPartitions(key, order).select(key, F.col(line).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_if_changed(df: DataFrame, path: str, known_digest: str | None) -> tuple[str, bool]:
    """A small settings table as one JSON text, written only if its digest is not the known one: (digest, written)."""
    rows = [r.asDict(recursive=True) for r in df.collect()]  # settings: tens of rows
    text = json.dumps(sorted(rows, key=str), ensure_ascii=False, sort_keys=True, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()
    if digest == known_digest:
        return digest, False
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return digest, True


def texts_of(spark: SparkSession, root: str, key: str, kind: str) -> DataFrame:
    """The newest text of each key under a root, its digest, and how often it was written."""
    rows = spark.read.schema(f"{key} {kind}, text string, digest string, version int").option("recursiveFileLookup", "true").parquet(root)
    last = rows.groupBy(key).agg(F.max_by(F.struct("text", "digest"), "version").alias("x"), F.count(F.lit(1)).cast("int").alias("written"))
    return last.select(key, "x.text", "x.digest", "written")


def changed_texts(df: DataFrame, root: str, key: str) -> None:
    """Writes the texts (key, text) whose digest differs from the newest one under root; keys and digests meet in a join."""
    new = df.withColumn("digest", F.sha2("text", 256))
    version = len(commits.names_in(df.sparkSession, root)) + 1
    if version > 1:
        known = texts_of(df.sparkSession, root, key, df.schema[key].dataType.simpleString()).select(key, "digest")
        new = new.join(known, [key, "digest"], "left_anti")
    new.select(key, "text", "digest", F.lit(version).alias("version")).write.parquet(f"{root}/{version}")


def server_events(df: DataFrame, name: str) -> DataFrame:
    """Rows as the text of server-sent events."""
    return df.select(F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(F.struct(*df.columns)), F.lit("\n\n")).alias("value"))


def appended(df: DataFrame, name: str) -> DataFrame:
    """Rows appended to a table that is empty, as its second version, and read back."""
    root = new_path(df.sparkSession, name)
    commits.commit(df.sparkSession, root, {name: df.limit(0)})
    commits.append(df.sparkSession, root, {name: df})
    return commits.read(df.sparkSession, root, name)
