"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the benchmark's items.

A text is normalised to its words, lower-cased, with one space before, between and behind. A window of an item is a
run of `window` of its words in the same form (a shorter item is one window). The automaton holds all windows; a text is
scanned once, and the end of an occurrence is mapped to word numbers, and to the byte offsets of the original.

One automaton is built from the benchmark's texts, which go to every executor, while their size is at most BLOCK_BYTES. With
a larger benchmark each document meets only the items that it may hold, and one automaton is built over those:
1. Every run of as many words as a window has is told by its anchor, the least hash of three words in it (of the whole run
   if it has fewer). A window that occurs has its anchor among the text's, of which there are about two in nine words.
2. A join on anchors gives each document's candidate items; equal item texts are one item there.
3. Documents with candidates and the texts of these meet by row, sorted, and stream through a kernel that builds automata of
   at most BLOCK_BYTES for one document at a time. So results are those of one automaton; documents are read once, and
   neither the driver nor a task holds the benchmark.

Defined results: null, empty and wordless texts have no words, hits or items; items without words match nothing; equal
windows of several items count for each; an item without an id makes hits but is not counted; repeated rows each give a row; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WINDOW = 10
#: Bytes of benchmark text in one automaton, at most (or one item).
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z; all ASCII but letters and digits becomes a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Windows:
    """The automaton over the windows of (item_id, text) pairs."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], window: int):
        import ahocorasick

        owners: dict[str, tuple[int, set]] = {}
        for item, text in items:
            words = words_of(text.encode())
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners.setdefault(f" {b' '.join(words[i : i + size]).decode()} ", (size, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, (size, of) in owners.items():
            self.automaton.add_word(pattern, (size, frozenset(of - {None})))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words; spans of words covered by windows (end exclusive, united); items that occur."""
        words = words_of(text)
        if not self.some or not words:
            return len(words), [], set()
        plain = f" {b' '.join(words).decode()} "
        found = list(self.automaton.iter(plain))
        if not found:
            return len(words), [], set()
        lengths = np.fromiter((len(w) for w in plain[1:-1].split(" ")), np.int64, len(words))
        word_end = np.cumsum(lengths + 1)  # the space behind each word
        last = np.searchsorted(word_end, [end for end, _ in found])
        spans: list[list[int]] = []
        items: set = set()
        for start, end in sorted((int(k) + 1 - size, int(k) + 1) for k, (_, (size, _)) in zip(last, found, strict=True)):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        for _, (_, of) in found:
            items |= of
        return len(words), [(a, b) for a, b in spans], items


@lru_cache(2)
def windows(items: tuple[tuple[int | None, str], ...], window: int) -> Windows:
    """One for each process and block of the benchmark."""
    return Windows(items, window)


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of spans of words."""
    plain = np.frombuffer(text.translate(TO_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], plain, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(start[a]), int(end[b - 1])) for a, b in spans]


def small_benchmark(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> tuple | None:
    """The items, if their texts have at most so many bytes."""
    items = benchmark.select(runtime.column(item_col).alias("item"), runtime.column(text_col).alias("text")).filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) > most:
        return None
    return tuple(sorted(((r.item, r.text) for r in items.collect()), key=str))


def _found(texts: list[bytes], scans: list[tuple[int, list[tuple[int, int]], set]]) -> dict[str, list]:
    return {
        "n_words": [n for n, _, _ in scans],
        "n_hit": [sum(b - a for a, b in spans) for _, spans, _ in scans],
        "n_items": [len(items) for _, _, items in scans],
        "item_ids": [sorted(map(str, items)) for _, _, items in scans],
        "hit_words": [[x for s in spans for x in s] for _, spans, _ in scans],
        "hit_bytes": [[x for s in offsets(t, spans) for x in s] if spans else [] for t, (_, spans, _) in zip(texts, scans, strict=True)],
    }


FOUND = "n_words long, n_hit long, n_items long, item_ids array<string>, hit_words array<long>, hit_bytes array<long>"


def scan(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: the id column, n_words, n_hit, n_items, item_ids (array<string>, sorted), hit_words and hit_bytes.

    hit_words and hit_bytes are arrays of start, end, start, end, ...: united spans of words, and of bytes of the text.
    """
    items = small_benchmark(benchmark, item_col, item_text, block_bytes)
    if items is None:
        rows = runtime.written(df.select(runtime.column(id_col).alias("id"), runtime.column(text_col).alias("text")).withColumn("row_key", F.monotonically_increasing_id()), "decontam-rows")
        counts, found = _joined(rows, benchmark, item_col, item_text, window, block_bytes)
        none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "hit_words": F.array().cast("array<long>"), "hit_bytes": F.array().cast("array<long>")}
        both = counts.join(found, "row_key", "left")
        return both.select(F.col("id").alias(id_col), "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))
    return runtime.map_rows(df, [id_col], text_col, lambda texts: _found(texts, [windows(items, window).scan(t) for t in texts]), FOUND)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df without the rows in whose text a window occurs."""
    items = small_benchmark(benchmark, item_col, item_text, block_bytes)
    if items is None:
        rows = runtime.written(runtime.numbered(df).withColumn("row_key", F.monotonically_increasing_id()), "decontam-rows")
        texts = rows.select("row_key", F.lit(None).cast("long").alias("id"), F.col(f"in_{df.columns.index(text_col)}").alias("text"))
        hit = _joined(texts, benchmark, item_col, item_text, window, block_bytes)[1].filter("n_hit > 0")
        return rows.join(hit.select("row_key"), "row_key", "left_anti").drop("row_key").toDF(*df.columns)
    return runtime.with_made(df, text_col, lambda texts: {"hit": [bool(windows(items, window).scan(t)[1]) for t in texts]}, "hit boolean", lambda rows: rows.filter("not hit"))


def anchors(words: list[bytes], size: int) -> np.ndarray:
    """The distinct anchors of all runs of so many words: least hashes of three words, told apart by size."""
    if len(words) < size or not size:
        return np.zeros(0, np.int64)
    of = xxhash.xxh64_intdigest
    each = np.fromiter((of(w, size) for w in words), np.uint64, len(words))
    width = min(3, size)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            mixed = (mixed ^ each[k : len(each) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(mixed, size - width + 1).min(axis=1)).view(np.int64)


def _joined(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (row_key, id, text): (row_key, id, n_words) of all, and what scan() returns of those with candidates, by row_key."""
    spark = rows.sparkSession
    texts = benchmark.select(runtime.column(item_col).cast("string").alias("item"), runtime.column(item_text).alias("text")).filter("text is not null")
    alike = texts.groupBy("text").agg(F.collect_set("item").alias("items")).withColumn("item_key", F.monotonically_increasing_id())
    alike = runtime.written(alike, "decontam-items")

    def of_items(found: list[bytes]) -> dict[str, list]:
        words = [words_of(t) for t in found]
        return {"size": [min(window, len(w)) for w in words], "anchors": [anchors(w, min(window, len(w))) for w in words]}

    parts = runtime.written(runtime.map_rows(alike, ["item_key"], "text", of_items, "size long, anchors array<long>").filter("size > 0"), "decontam-anchors")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most `window` numbers

    def of_rows(found: list[bytes]) -> dict[str, list]:
        words = [words_of(t) for t in found]
        return {"n_words": list(map(len, words)), "anchors": [np.concatenate([anchors(w, s) for s in sizes] or [np.zeros(0, np.int64)]) for w in words]}

    known = runtime.written(runtime.map_rows(rows, ["row_key", "id"], "text", of_rows, "n_words long, anchors array<long>"), "decontam-words")
    pairs = known.select("row_key", F.explode("anchors").alias("anchor")).join(parts.select("item_key", F.explode("anchors").alias("anchor")), "anchor").select("row_key", "item_key").distinct()
    pairs = runtime.written(pairs, "decontam-pairs")
    asked = rows.join(pairs.select("row_key").distinct(), "row_key", "left_semi").select("row_key", F.lit(-1).cast("long").alias("item_key"), "text", F.array().cast("array<string>").alias("items"))
    both = asked.unionByName(pairs.join(alike, "item_key").select("row_key", "item_key", "text", "items")).repartition("row_key").sortWithinPartitions("row_key", "item_key")
    return known.select("row_key", "id", "n_words"), both.mapInArrow(_verified(window, block_bytes), f"row_key long, {FOUND}").drop("n_words")


def _verified(window: int, block_bytes: int):
    """Kernel: a document, then its candidate items, row after row; one result a document."""
    kinds = [(x.split(" ")[0], runtime.TYPES[x.split(" ")[1]]) for x in FOUND.split(", ")]
    schema = pa.schema([("row_key", pa.int64()), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, held, size, spans, items = None, b"", [], 0, [], set()

        def look() -> None:
            nonlocal held, size, spans
            _, more, owners = Windows(tuple(held), window).scan(text)
            for of in owners:
                items.update(of)
            merged: list[list[int]] = []
            for a, b in sorted([*spans, *more]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            held, size, spans = [], 0, [tuple(s) for s in merged]

        def done() -> pa.RecordBatch:
            if held:
                look()
            made = _found([text], [(len(words_of(text)), spans, items)])
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array(made[n], t) for n, t in kinds)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                k, item, raw, owners = (batch.column(j)[i].as_py() for j in range(4))
                if item < 0:
                    if key is not None:
                        yield done()
                    key, text, held, size, spans, items = k, (raw or "").encode(), [], 0, [], set()
                    continue
                if held and size + len(raw) > block_bytes:
                    look()
                held.append((tuple(owners), raw))
                size += len(raw)
        if key is not None:
            yield done()

    return run


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every whole text of documents."""
    found = scan(runtime.table(spark, sf_dir, "documents", "doc_id", "text"), runtime.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Words and windows in SQL. Tables of distinct windows meet in an equi-join; hit words are distinct positions.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), sizes as (select distinct n from bw
), dw as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), hit as (select r, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n
), words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r
), items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""
