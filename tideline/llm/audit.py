"""Filter interaction audit: what five filters remove in each of their 120 orders, and what each is worth by Shapley's rule.

1. Each document gets a mask: bit i is set if filter i of FILTERS would remove it. Four filters look at the text. The
   fifth, copies, is answered without a join of documents: rows shrink to (id, digest of the text, mask, part, labels),
   rows alike are counted before they are shuffled, and only the smallest id of each digest meets the others, by group.
2. Counts by part and mask (at most 32 a part) are the coefficients of the part's removal polynomial. With x_i the chance
   that filter i is in use, a document of mask m is removed with 1 - prod over m of (1 - x_i); multiplied out, the
   coefficient of the product over T is (-1)^(|T| + 1) times the documents whose mask holds T.
3. The polynomial at corner S counts what the filters of S remove together: an order's survivors, step by step.
4. The Shapley value of i is the integral of the i-th partial derivative along the diagonal: over T with i, the
   coefficient of T times the integral of t^(|T| - 1), which is 1 / |T|. Times 120 every such fraction is whole, so sums
   of long numbers are exact.

All of it is DataFrame functions. What is broadcast are tables of 32 masks and 120 orders.

Defined results: a null text is empty and a null part is the empty string. A null id is no copy and nobody's original;
repeated rows count as often as they occur, and equal ids are not smaller than each other. A document with several label
rows is good (toxic) if one of them says so; one without is neither. An empty table gives no rows. Columns beside those
named are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)


def failing(text: Column, words: Column) -> dict[str, Column]:
    """The conditions by which the filters that need one text only remove it."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def slim(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows alike with how many they are: (part, mask of A to D, digest, id, good, toxic, n)."""
    read = docs.select(runtime.column(id_col).alias("id"), F.coalesce(runtime.column(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(runtime.column(text_col), F.lit("")).alias("text"))
    cut = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(cond, 1 << FILTERS.index(name)).otherwise(0) for name, cond in failing(F.col("text"), F.col("words")).items()]
    rows = cut.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.join(marks, "id", "left").select("id", "part", "digest", "mask", *told).groupBy("id", "part", "digest", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) over all five filters. A digest is a few groups by now, however many copies it has."""
    alike = ["digest", "part", "mask", "good", "toxic"]
    known = F.col("id").isNotNull()
    groups = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    original = F.min("first.id").over(Window.partitionBy("digest"))
    stay = F.col("nameless") + F.when(F.col("first.id") == F.col("original"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("original", original).select(*alike, F.explode(F.array(F.struct(F.lit(0).alias("copy"), stay.alias("n")), F.struct(F.lit(COPY).alias("copy"), (F.col("n") - stay).alias("n")))).alias("x"))
    counted = split.select("part", (F.col("mask") + F.col("x.copy")).alias("mask"), "good", "toxic", F.col("x.n").alias("n"))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def _bits(mask: int) -> list[int]:
    return [i for i in range(len(FILTERS)) if mask >> i & 1]


def polynomial(counts: DataFrame) -> DataFrame:
    """The coefficient of each product of variables (term, a mask) for all documents, good and toxic ones; by part."""
    spark = counts.sparkSession
    terms = spark.createDataFrame([(m, t, (-1) ** (len(_bits(t)) + 1) if t else 0) for m in range(MASKS) for t in range(MASKS) if t & m == t], "mask int, term int, sign int")
    return counts.join(F.broadcast(terms), "mask").groupBy("part", "term").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic")))


def corners(terms: DataFrame) -> DataFrame:
    """How many documents each set of filters removes: the polynomial where those variables are 1 and the others 0."""
    within = terms.sparkSession.createDataFrame([(t, s) for s in range(MASKS) for t in range(MASKS) if t & s == t], "term int, filters int")
    return terms.join(F.broadcast(within), "term").groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def shapley(terms: DataFrame) -> DataFrame:
    """Each filter's Shapley value times the number of orders, from the integrals of the partial derivatives."""
    orders = factorial(len(FILTERS))
    weights = terms.sparkSession.createDataFrame([(t, i, orders // len(_bits(t))) for t in range(1, MASKS) for i in _bits(t)], "term int, filter int, weight int")
    return terms.join(F.broadcast(weights), "term").groupBy("part", "filter").agg(F.sum(F.col("n") * F.col("weight")).alias("shapley"))


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts by mask."""
    spark = counts.sparkSession
    terms = polynomial(counts)
    at = corners(terms).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filters", F.struct("n", "good", "toxic")))).alias("at"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("documents"))
    every = totals.select("*", F.explode(F.array(*map(F.lit, range(len(FILTERS))))).alias("filter"))
    values = every.join(shapley(terms), ["part", "filter"], "left").join(at, "part")
    steps = []
    for order in permutations(range(len(FILTERS))):
        used = 0
        for k, i in enumerate(order):
            steps.append((i, "".join(FILTERS[j] for j in order), k + 1, used, used | 1 << i))
            used |= 1 << i
    orders = spark.createDataFrame(steps, "filter int, filter_order string, step int, before int, after int")
    one = F.pow(F.lit(2), F.col("filter")).cast("int")
    rest = F.lit(MASKS - 1) - one
    get = lambda mask, what: F.element_at("at", mask)[what]
    here = {c: get(F.col("after"), c) - get(F.col("before"), c) for c in ("n", "good", "toxic")}
    return values.join(F.broadcast(orders), "filter").select(
        "part", "filter_order", "step", (F.col("documents") - get(F.col("after"), "n")).alias("kept"), here["n"].alias("removed"), (get(one, "n") - here["n"]).alias("redundant"), (get(F.lit(MASKS - 1), "n") - get(rest, "n")).alias("unique_fails"),
        here["good"].alias("good_lost"), here["toxic"].alias("toxic_lost"), F.coalesce("shapley", F.lit(0)).cast("long").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language: each order's steps and each filter's Shapley value."""
    docs = runtime.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return interactions(mask_counts(slim(docs, runtime.table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))))


#: All orders played out: each mask's documents go at the first of their filters in the order.
SQL = r"""
with marks as (
  select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by 1
), d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when coalesce(d.doc_id > min(d.doc_id) over (partition by t), false) then 'E' else '' end as mask
  from d left join marks on d.doc_id = marks.doc_id
), c as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by 1, 2
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select part, filter_order, cast(step as integer) as step, filter_order[step] as f, n, good, toxic, mask, contains(mask, filter_order[step]) as fails,
    len(list_filter(string_split(mask, ''), lambda x: x <> '' and strpos(filter_order, x) < step)) > 0 as earlier
  from c, orders, (select unnest(range(1, 6)) as step)
), played as (
  select part, filter_order, step, f, coalesce(sum(n) filter (where not fails and not earlier), 0) as kept, coalesce(sum(n) filter (where fails and not earlier), 0) as removed, coalesce(sum(n) filter (where fails and earlier), 0) as redundant,
    coalesce(sum(n) filter (where mask = f), 0) as unique_fails, coalesce(sum(good) filter (where fails and not earlier), 0) as good_lost, coalesce(sum(toxic) filter (where fails and not earlier), 0) as toxic_lost
  from steps group by 1, 2, 3, 4
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from played
"""
