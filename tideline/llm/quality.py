"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers. Every feature has a table of log-odds by bin, and so have a few pairs of features. The
tables are learned by cyclic boosting: round after round, feature by feature, a shallow tree over the feature's bins is
fitted to the gradient and added, shrunk, to the table; the pairs with most left to gain follow in the same way. A
score is the logistic of the sum of the bins' entries, so scoring is one look-up and addition for each table, over
whole columns at a time.

The model is fitted on the driver from at most TRAIN_ROWS labelled rows, the ones with the smallest hash of the id; that
is the only bound, and features and scores are taken from whole texts. Repeated ids among labels or texts count once.

Defined results: null and empty texts have all features zero and get a score like any other; without labels, or with
labels of one kind, all texts get the labels' smoothed rate; equal texts get equal scores; repeated rows each give a
row; a null id is no training row and is not held out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
KEEP_AT = 0.7

FEATURES = ("log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "marks", "stops", "pipes", "distinct_words", "distinct_lines", "line_words", "wide", "function_words", "repeats")
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#$%&*@^~<>{}[]\\=+_"
#: Frequent short words of the four languages, as bytes in lower case.
FUNCTION_WORDS = frozenset(w.encode() for w in "the of and to in is that it was for on are with as be by this from a or der die und das ist von zu den mit sich des auf für nicht ein eine dem im le la les de et des du en un une que qui est pour dans par sur pas au avec el los las y del se por con para su al".split())


def features(text: bytes) -> tuple[float, ...]:
    """The numbers of one text, in the order of FEATURES; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(text)
    without = lambda chars: size - len(text.translate(None, chars))
    lines = text.split(b"\n")
    lowered = text.lower().split()
    distinct = len(set(lowered))
    return (
        float(np.log(size)), float(np.log(n)), size / n, float(np.log(max(map(len, words)))), without(UPPER) / size, without(DIGITS) / size, without(SYMBOLS) / n, text.count(b"!") / n,
        text.count(b".") / n, text.count(b"|") / n, distinct / n**0.75, len(set(lines)) / len(lines), float(np.log(n / len(lines))), 1 - len(text.decode()) / size,
        sum(map(FUNCTION_WORDS.__contains__, lowered)) / n, len(set(zip(lowered, lowered[1:]))) / max(1, n - 1),
    )


@dataclass
class Model:
    """Edges and table of each feature; edges and tables of pairs; all log-odds."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins in order; g and h are sums of gradients and curvatures by bin."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h >= least) & (right_h >= least), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1), 0.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 2.0) -> np.ndarray:
    """The steps of a tree over bins in order."""
    gain, cut = _best_cut(g, h, least) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate((_tree(g[:cut], h[:cut], depth - 1, least), _tree(g[cut:], h[cut:], depth - 1, least)))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the better tree that cuts one axis of a table and then each side along the other."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + 1)))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        gain, cut = _best_cut(gg.sum(1), hh.sum(1), 2.0)
        if gain <= 1e-9:
            continue
        steps = np.empty(gg.shape)
        for side in (slice(0, cut), slice(cut, None)):
            more, _ = _best_cut(gg[side].sum(0), hh[side].sum(0), 2.0)
            gain += more
            steps[side] = _tree(gg[side].sum(0), hh[side].sum(0), 1)
        if gain > best[0]:
            best = gain, steps.T if turn else steps
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 60) -> Model:
    """A model of y (0 or 1) by rows of features; the same rows in the same order give the same model."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(p / (1 - p))))
    if len(set(y.tolist())) < 2:
        return model
    quantiles = lambda n: [np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) for k in range(x.shape[1])]
    model.edges = quantiles(bins)
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            q = 1 / (1 + np.exp(-total))
            g, h = np.bincount(at[k], y - q, len(table)), np.bincount(at[k], q * (1 - q), len(table))
            step = rate * _tree(g, h, 2)
            table += step
            total += step[at[k]]
    model.pair_edges = quantiles(pair_bins)
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def sums(a: int, b: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = shape(a, b)
        cell = at[a] * columns + at[b]
        return np.bincount(cell, y - q, rows * columns).reshape(rows, columns), np.bincount(cell, q * (1 - q), rows * columns).reshape(rows, columns)

    q = 1 / (1 + np.exp(-total))
    gains = sorted(((-_pair_tree(*sums(a, b, q))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [(a, b) for _, a, b in gains[:pairs]]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = rate * _pair_tree(*sums(a, b, 1 / (1 + np.exp(-total))))[1]
            table += step
            total += step[at[a], at[b]]
    return model


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, modulus: int = 4, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows that are not held out: at most `rows`, by the smallest hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(remainder("id", modulus) != held_out)
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # at most `rows` ids
    got = runtime.map_rows(found, ["id", "y"], "text", _kernel, "x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r.id)
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float))


def _kernel(texts: list[bytes]) -> dict[str, list]:
    return {"x": [features(t) for t in texts]}


def accepted(df: DataFrame, model: Model, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of df whose score is at least keep_at, with df's columns whatever their names."""

    def kernel(texts: list[bytes]) -> dict[str, list]:
        return {"good": model.score(np.array([features(t) for t in texts])) >= keep_at}

    return runtime.with_made(df, text_col, kernel, "good boolean", lambda rows: rows.filter("good"))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id column, the columns of keep, score, predicted (1 where the score is at least keep_at)."""

    def kernel(texts: list[bytes]) -> dict[str, list]:
        p = model.score(np.array([features(t) for t in texts]))
        return {"score": p, "predicted": (p >= keep_at).astype(np.int32)}

    return runtime.map_rows(df, list(dict.fromkeys([id_col, *keep])), text_col, kernel, "score double, predicted int")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of documents."""
    docs = runtime.table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, runtime.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
