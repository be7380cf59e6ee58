"""LM scoring: smoothed word trigrams as a weighted backoff automaton, learned and applied without collecting the model.

The automaton has a root, a state for the start and for each word just read, and a state for two words just read where
both are frequent (each holds at least 1 / FREQUENT of training's tokens; the start counts as frequent). An arc from a
state reads a word that followed it in training; a state's failure arc leads, without reading, to the state that has
forgotten the older word, and from there to the root, which reads any word.

    root            log10 p(w),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    arc of h        log10 p(w | h),  p(w | h) = a c(h w) / c(h) + (1 - a) p(w | h without its older word)
    failure of h    log10 (1 - a)

c(h) is the count of the state's words in training (the start's: the number of texts); a depends on how many words the
state has and on the power of two that c(h) lies in: it is the share of that class's training tokens whose n-gram occurs
more than once, which is Good and Turing's estimate of how often an arc will do. Arcs and failure of a state sum to one.

The model grows with the corpus, so it is never broadcast. Texts are read once into chunks of about CHUNK tokens; a chunk
is a word list (as hashes) and the texts as numbers in it. Frequent words, at most FREQUENT of them, are found first, and
their hashes go to every task. Each chunk asks for its distinct words, pairs and triples, sorted by hash and dealt to
2 ** RANGE_BITS ranges of hashes, with its own counts: so many rows for each chunk, however many chunks there are. Where a
range would hold more than SHARD keys, batches of chunks are merged within it, and what is merged is dealt to as many finer
ranges, level by level. The range adds up counts and answers go back the same way. A key crosses the network once per
chunk and level and back, whatever its frequency. A chunk with its answers is the part of the automaton that its texts
walk through; one traversal from left to right carries the state and adds weights.

Words, pairs and triples are told apart by hashes of SPARE_BITS more bits than the logarithm of the number of tokens (64 at
most): at any size one look-up in 2 ** SPARE_BITS, 17 million, at most meets the count of another key.

Defined results: null and empty texts have one token, the end; repeated rows and ids each give a row and count in
training each time; without training texts p is even and no arc exists; a null id is a row like any other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import runtime

#: Tokens of a chunk, about: a text is not cut.
CHUNK = 700_000
#: Keys that a task adds up, about; and ranges of hashes that a chunk's keys are dealt to, as a power of two.
SHARD = 2_000_000
RANGE_BITS = 10
#: Bits that a key has beside the logarithm of the number of tokens.
SPARE_BITS = 24
#: Words with less than this share's inverse of training's tokens are no part of two-word states.
FREQUENT = 1000
CLASSES = 64
#: The end of a text as a word; no word has white space.
END = b" "


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes by significance, compressed: the high bytes of small numbers vanish."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(first + np.uint64(0x9E3779B97F4A7C15)) + second)


#: Keeps triples' keys apart from those of pairs.
_THREE = np.uint64(0xA0761D6478BD642F)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased (A-Z), and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if keep.all():
        return words, sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    return words.filter(full), np.bincount(of[keep], minlength=len(sizes))


def _chunk(ids: list, train: list, words: list[pa.Array], sizes: list[np.ndarray]) -> dict:
    """A chunk's row: word hashes (the end first), and the texts as numbers in that list, each with its end (0)."""
    size = np.concatenate(sizes)
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode() if len(words) > 1 else words[0].dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    ends = np.cumsum(size + 1) - 1
    numbers = np.zeros(int(size.sum()) + len(size), np.uint32)
    inner = np.ones(len(numbers), bool)
    inner[ends] = False
    numbers[inner] = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(1)
    own = np.concatenate((np.array([xxhash.xxh3_64_intdigest(END)], np.uint64), known))
    return {"n_tokens": len(numbers), "ids": ids, "train": train, "sizes": _pack((size + 1).astype(np.uint32)), "words": _pack(own), "numbers": _pack(numbers)}


class Chunk:
    """A chunk's tokens in order, and its distinct words, pairs and triples in order of their keys.

    frequent: the sorted hashes of the words of two-word states. triple_at is -1 where a token has no such state before it.
    """

    def __init__(self, sizes: bytes, words: bytes, numbers: bytes, train: list, frequent: np.ndarray):
        self.size = _unpack(sizes, np.uint32).astype(np.int64)
        hashes, self.word = _unpack(words, np.uint64), _unpack(numbers, np.uint32).view(np.int32)
        before = np.empty_like(self.word)
        before[1:], before[:1] = self.word[:-1], 0  # the state; the end's number stands for the start
        self.before = before
        self.train = np.repeat(np.array(train, bool), self.size)
        self.starts = np.cumsum(self.size) - self.size
        self.word_keys, self.word_at = self._order(_mixed(hashes), self.word)
        pairs, place = np.unique(before.astype(np.int64) * len(hashes) + self.word, return_inverse=True)
        pair_hash = _pair(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
        self.pair_keys, self.pair_at = self._order(pair_hash, place)
        often = np.isin(hashes, frequent)
        often[:1] = True  # as a state the first number is the start
        two = often[before]
        two[1:] &= often[before[:-1]]
        two[self.starts] = False
        at = np.flatnonzero(two)
        triples, own = np.unique(place[at - 1].astype(np.int64) * len(hashes) + self.word[at], return_inverse=True)
        self.triple_keys, found = self._order(_pair(pair_hash[triples // len(hashes)] ^ _THREE, hashes[triples % len(hashes)]), own)
        self.triple_at = np.full(len(self.word), -1, np.int32)
        self.triple_at[at] = found

    def kinds(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.word_keys, self.word_at), (self.pair_keys, self.pair_at), (self.triple_keys, self.triple_at)]

    @staticmethod
    def _order(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        return keys[order], place[at]


def _fields(schema: str, kinds: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def chunks(df: DataFrame, id_col: str, text_col: str, train: Column, size: int = CHUNK) -> DataFrame:
    """Texts as chunks, written to the shared folder: all that follows starts from the same chunks, whatever is lost."""
    runtime.python_path(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"chunk string, n_tokens long, ids array<{kind.simpleString()}>, train array<boolean>, sizes binary, words binary, numbers binary"
    target = pa.schema([("chunk", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("words", pa.binary()), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, flags, words, sizes, n = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": f"{part}-{k}", **_chunk(ids, flags, words, sizes)}], schema=target)

        for batch in batches:
            for rows in runtime.slices(batch, "text"):
                w, s = _tokens(rows.column("text"))
                ids += rows.column("id").to_pylist()
                flags += rows.column("train").to_pylist()
                words.append(w)
                sizes.append(s)
                n += len(w) + len(s)
                if n >= size:
                    yield made()
                    ids, flags, words, sizes, n, k = [], [], [], [], 0, k + 1
        if ids:
            yield made()

    return runtime.written(rows.mapInArrow(run, schema), "ngram-chunks")


_ASKED = "unit string, kind int, range long, keys binary, counts binary"


def _dealt(unit: str, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, width: int) -> pa.RecordBatch:
    """Sorted keys of so many bits as a row for each range that has any; a range is the keys' first bits."""
    of = (keys >> np.uint64(width - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    rows = [{"unit": unit, "kind": kind, "range": int(of[a]), "keys": _pack(np.diff(keys[a:b], prepend=np.uint64(0))), "counts": _pack(counts[a:b])} for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)])]
    return pa.RecordBatch.from_pylist(rows, schema=_fields(_ASKED, _KINDS))


def _keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _ask(bits: int, frequent: np.ndarray, width: int = 64):
    """Kernel: each chunk's distinct keys by kind (words, pairs, triples) and range, with the chunk's counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = Chunk(r["sizes"], r["words"], r["numbers"], r["train"], frequent)
            for kind, (keys, at) in enumerate(c.kinds()):
                yield _dealt(r["chunk"], kind, keys >> np.uint64(64 - width), np.bincount(at[c.train & (at >= 0)], minlength=len(keys)).astype(np.uint32), bits, width)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: only one chunk's values are Python objects at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_ANSWERED = "unit string, kind int, range long, counts binary, n_known long"


def _summed(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The rows' keys, all distinct keys in order, the sums of their counts, and where each row's keys stand among them."""
    keys = [_keys(r["keys"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, np.bincount(at, np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]), len(distinct)).astype(np.int64), at


def _replies(rows: list[dict], keys: list[np.ndarray], at: np.ndarray, total: np.ndarray, known: int) -> pa.Table:
    """An answer to each row, in the order of its keys. known, of keys that training has, stands in one row."""
    ends = np.cumsum([len(k) for k in keys])
    out = [{"unit": r["unit"], "kind": r["kind"], "range": r["range"], "counts": _pack(total[at[e - len(k) : e]]), "n_known": known if i == 0 else 0} for i, (r, k, e) in enumerate(zip(rows, keys, ends))]
    return pa.Table.from_pylist(out, schema=_fields(_ANSWERED, _KINDS))


def _answer(table: pa.Table) -> pa.Table:
    """One range of one kind: counts added up over all units, and each unit's answer."""
    rows = table.to_pylist()
    keys, _, total, at = _summed(rows)
    return _replies(rows, keys, at, total, int((total > 0).sum()))


def _merge(bits: int, width: int):
    """Kernel: a batch of units within a range as one unit, dealt to ranges of so many bits."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, distinct, total, _ = _summed(rows)
        r = rows[0]
        if int(total.max(initial=0)) >> 32:
            raise OverflowError("a count of 2 ** 32 in one batch")
        return pa.Table.from_batches([_dealt(f"{r['kind']}:{r['range']}:{r['batch']}", r["kind"], distinct, total.astype(np.uint32), bits, width)], schema=_fields(_ASKED, _KINDS))

    return run


def _passed_on(left: pa.Table, right: pa.Table) -> pa.Table:
    """The answers to a merged unit (right, by range) as answers to the units that it was merged of (left)."""
    rows = left.to_pylist()
    keys, distinct, _, at = _summed(rows)
    answers = sorted(right.to_pylist(), key=lambda r: r["finer"])
    total = np.concatenate([_unpack(x["counts"], np.int64) for x in answers])
    if len(total) != len(distinct):
        raise RuntimeError(f"{rows[0]['kind']}, {rows[0]['range']}: answers do not fit its keys")
    return _replies(rows, keys, at, total, sum(x["n_known"] for x in answers))


def totals(asked: DataFrame, keys: float, shard: int, bits: int, width: int, level: int = 1) -> DataFrame:
    """Answers (unit, kind, range, counts, n_known) to what units ask: the counts of their keys, added up over all units.

    keys: how many there may be of a kind in a range; more than shard are merged batch by batch and dealt to finer ranges.
    """
    if keys <= shard or bits * (level + 1) > width:
        return asked.groupBy("kind", "range").applyInArrow(_answer, _ANSWERED)
    batches = int(np.ceil(keys / shard))
    held = runtime.written(asked.withColumn("batch", F.pmod(F.xxhash64("unit"), F.lit(batches))), f"ngram-asked-{level}")
    merged = held.groupBy("kind", "range", "batch").applyInArrow(_merge(bits * (level + 1), width), _ASKED)
    finer = totals(runtime.written(merged, f"ngram-merged-{level}"), keys / (1 << bits), shard, bits, width, level + 1)
    part = F.split("unit", ":")
    finer = finer.select(part[0].cast("int").alias("kind"), part[1].cast("long").alias("range"), part[2].cast("long").alias("batch"), F.col("range").alias("finer"), "counts", "n_known")
    on = ("kind", "range", "batch")
    return held.groupBy(*on).cogroup(finer.groupBy(*on)).applyInArrow(_passed_on, _ANSWERED)


def frequent_words(held: DataFrame, share: int) -> np.ndarray:
    """The sorted hashes of the words that hold at least 1 / share of training's tokens: share of them at most.

    Chunks name the words that hold half that share of their own tokens. Where it is less a word has less than half of the
    least count that counts, so in the chunks that name it it has the other half: 2 x share words at most have, and these
    are counted exactly.
    """
    runtime.python_path(held.sparkSession)

    def counts(words: bytes, numbers: bytes, sizes: bytes, train: list) -> tuple[np.ndarray, np.ndarray]:
        inside = np.repeat(np.array(train, bool), _unpack(sizes, np.uint32))
        hashes = _unpack(words, np.uint64)
        return hashes, np.bincount(_unpack(numbers, np.uint32)[inside], minlength=len(hashes))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            hashes, n = counts(r["words"], r["numbers"], r["sizes"], r["train"])
            often = (n > 0) & (2 * n * share >= n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes[often].view(np.int64), 0)), pa.array(np.append(n[often], n.sum()))], names=["hash", "n"])

    rows = runtime.written(held.select("words", "numbers", "sizes", "train").mapInArrow(named, "hash long, n long"), "ngram-named")
    total = rows.filter("hash = 0").agg(F.sum("n").alias("n")).first().n or 0  # no word's hash is zero but with a chance of 2 ** -64
    some = rows.filter("hash <> 0").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * share >= total)
    candidates = np.sort(np.array([r.hash for r in some.select("hash").collect()], np.int64).view(np.uint64))  # 2 x share rows at most

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            hashes, n = counts(r["words"], r["numbers"], r["sizes"], r["train"])
            own = np.isin(hashes, candidates) & (n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(n[own])], names=["hash", "n"])

    if not len(candidates):
        return candidates
    sums = held.select("words", "numbers", "sizes", "train").mapInArrow(exact, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") * share >= total)
    return np.sort(np.array([r.hash for r in sums.collect()], np.int64).view(np.uint64))  # at most share rows


def _counted(id_type: pa.DataType, frequent: np.ndarray):
    """Kernel: a chunk and its answers become, token by token, the counts of word, pair and triple; and sums by class.

    Triples are stored as their count and one, and as 0 where there is no two-word state. single and total have CLASSES
    entries for one-word states, then as many for two-word states.
    """
    target = pa.schema([("ids", pa.list_(id_type)), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()), ("triples", pa.binary()), ("single", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())), ("n_train", pa.int64()), ("n_known", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["range"]))
        for r in left.to_pylist():
            c = Chunk(r["sizes"], r["words"], r["numbers"], r["train"], frequent)
            got = []
            for kind, (keys, at) in enumerate(c.kinds()):
                of = np.concatenate([np.zeros(0, np.int64), *(_unpack(x["counts"], np.int64) for x in answers if x["kind"] == kind)])
                if len(of) != len(keys):
                    raise RuntimeError(f"chunk {r['chunk']}: answers do not fit its keys")
                got.append(np.where(at >= 0, of[at] if len(of) else 0, -1))
            words, pairs, triples = got
            single, total = [], []
            for state, seen, has in ((_before(words, c.starts, of_start(words, c)), pairs, c.train), (_before(pairs, c.starts, 0), triples, c.train & (triples >= 0))):
                kind = classes(state[has])
                single += np.bincount(kind, seen[has] == 1, CLASSES).astype(int).tolist()
                total += np.bincount(kind, minlength=CLASSES).tolist()
            out.append({"ids": r["ids"], "train": r["train"], "sizes": r["sizes"], "words": _pack(words.astype(np.int64)), "pairs": _pack(pairs.astype(np.int64)), "triples": _pack((triples + 1).astype(np.int64)), "single": single, "total": total, "n_train": int(c.train.sum()), "n_known": sum(x["n_known"] for x in answers if x["kind"] == 0)})
        return pa.Table.from_pylist(out, schema=target)

    return run


def of_start(words: np.ndarray, c: Chunk) -> int:
    """How often the start occurs in training: as often as the end, which is each text's last token."""
    return int(words[c.starts[0] + c.size[0] - 1])


def _before(counts: np.ndarray, starts: np.ndarray, at_start: int) -> np.ndarray:
    """The counts one token earlier; at the texts' first tokens a value of its own."""
    out = np.empty_like(counts)
    out[1:], out[starts] = counts[:-1], at_start
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """The power of two that a count lies in; 0 for counts under 2."""
    return np.frexp(np.maximum(counts, 1).astype(float))[1].astype(np.int64) - 1


class Automaton:
    """The part of the automaton that a chunk's texts walk through, and its weights.

    Level 0 is the root, 1 the states of one word, 2 those of two. Per level and token: whether the walk has a state there,
    whether that state has an arc that reads the token, the arc's weight, and the weight of the state's failure arc, which
    leads one level down.
    """

    def __init__(self, n: int, v: int, single: list[int], total: list[int]):
        self.n, self.v = n, v
        #: By level and class: how often an arc will do; between 0 and 1, so that every failure arc has a weight.
        self.arc = (1 - (np.array(single, float) + 1) / (np.array(total, float) + 2)).reshape(2, CLASSES)

    def root(self, words: np.ndarray) -> np.ndarray:
        return np.log10((words + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def levels(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: np.ndarray, n_texts: int) -> list[tuple[np.ndarray, ...]]:
        """(state, has arc, arc weight, failure weight) of the levels from 0 up; triples are -1 where there is no two-word state."""
        always = np.ones(len(words), bool)
        found = [(always, always, self.root(words), np.zeros(len(words)))]
        for k, (history, seen) in enumerate(((_before(words, starts, n_texts), pairs), (np.where(triples >= 0, _before(pairs, starts, 0), 0), np.maximum(triples, 0)))):
            state = history > 0
            a = np.where(state, self.arc[k][classes(history)], 0.0)
            lower = 10 ** _walked(found)
            found.append((state, state & (seen > 0), np.log10(a * seen / np.maximum(history, 1) + (1 - a) * lower), np.log10(1 - a)))
        return found

    def walk(self, *counts) -> np.ndarray:
        """The weight of each step of one traversal from left to right."""
        return _walked(self.levels(*counts))


def _walked(levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """From its highest state each token follows failure arcs, adding their weights, to the first state with an arc that reads it."""
    weight = np.zeros(len(levels[0][0]))
    open_ = np.ones(len(weight), bool)
    for state, arc, reads, fails in reversed(levels):
        here = open_ & state
        weight[here] += np.where(arc, reads, fails)[here]
        open_ &= ~(here & arc)
    return weight


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, shard: int = SHARD, frequent: int = FREQUENT, bits: int = RANGE_BITS) -> DataFrame:
    """Per row: the id column, held_out (not in training), n_tokens, n_known, train_tokens, base_score, score.

    train: a boolean column, null as false. Scores are log10 probabilities, rounded to six places.
    """
    spark = df.sparkSession
    held = chunks(df, id_col, text_col, train, chunk)
    tokens = held.agg(F.sum("n_tokens").alias("n")).first().n or 0
    often = frequent_words(held, frequent)
    width = min(64, max(bits, int(np.ceil(np.log2(tokens + 2))) + SPARE_BITS))
    asked = held.select("chunk", "sizes", "words", "numbers", "train").mapInArrow(_ask(bits, often, width), _ASKED)
    answered = runtime.written(totals(asked, tokens / (1 << bits), shard, bits, width), "ngram-answers")
    runtime.release(spark)  # what was asked is far larger than the answers
    id_type = held.schema["ids"].dataType.elementType
    schema = f"ids array<{id_type.simpleString()}>, train array<boolean>, sizes binary, words binary, pairs binary, triples binary, single array<long>, total array<long>, n_train long, n_known long"
    counted = runtime.written(held.groupBy("chunk").cogroup(answered.withColumnRenamed("unit", "chunk").groupBy("chunk")).applyInArrow(_counted(to_arrow_type(id_type), often), schema), "ngram-counted")
    by_class = {r.k: (r.s, r.t) for r in counted.select(F.posexplode(F.arrays_zip("single", "total")).alias("k", "x")).groupBy("k").agg(F.sum("x.single").alias("s"), F.sum("x.total").alias("t")).collect()}  # 2 x CLASSES rows
    sums = counted.agg(F.sum("n_train").alias("n"), F.sum("n_known").alias("v"), F.sum(F.expr("size(filter(train, x -> x))")).alias("texts")).first()
    model = Automaton(sums.n or 0, sums.v or 0, *([by_class.get(k, (0, 0))[i] for k in range(2 * CLASSES)] for i in (0, 1)))
    texts = sums.texts or 0
    kept = to_arrow_type(id_type)
    target = pa.schema([("id", kept), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            size = _unpack(r["sizes"], np.uint32).astype(np.int64)
            words, pairs, triples = (_unpack(r[k], np.int64) for k in ("words", "pairs", "triples"))
            starts = np.cumsum(size) - size
            add = lambda x: np.round(np.add.reduceat(x, starts), 6)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], kept), pa.array([not t for t in r["train"]]), pa.array(size), pa.array(np.add.reduceat((words > 0).astype(np.int64), starts)), pa.array(np.full(len(size), model.n, np.int64)), pa.array(add(model.root(words))), pa.array(add(model.walk(words, pairs, triples - 1, starts, texts)))], schema=target)

    out = counted.select("ids", "train", "sizes", "words", "pairs", "triples").mapInArrow(run, f"id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.toDF(id_col, *out.columns[1:])


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every whole text of documents under trigrams of those that are not held out."""
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    return score(runtime.table(spark, sf_dir, "documents", "doc_id", "text"), part != 1)


#: crc32 of an id's digits, bit by bit; words, pairs, triples and classes as tables.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda i: cast(i as bigint))), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::bigint) % 5 = 1 as held_out,
    list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') as ws from documents
), k as (select r, held_out, unnest(ws) as w, unnest(list_prepend(' ', ws[1 : len(ws) - 1])) as p, unnest(list_prepend(null, list_prepend(' ', ws[1 : len(ws) - 2]))[1 : len(ws)]) as q from d
), one as (select w, count(*) as c from k where not held_out group by w
), two as (select p, w, count(*) as c2 from k where not held_out group by p, w
), total as (select cast(sum(c) as bigint) as n, count(*) as v from one
), often as (select w from one cross join total where c * 1000 >= n and w <> ' ' union all select ' '
), m as (select k.*, q is not null and q in (from often) and p in (from often) as pair_state from k
), three as (select q, p, w, count(*) as c3 from m where not held_out and pair_state group by q, p, w
), t as (select m.r, m.held_out, m.pair_state, coalesce(one.c, 0) as c, coalesce(h.c, 0) as cp, coalesce(two.c2, 0) as c2, case when m.pair_state then coalesce(g.c2, 0) else 0 end as cq, coalesce(c3, 0) as c3
  from m left join one on one.w = m.w left join one h on h.w = m.p left join two on two.p = m.p and two.w = m.w left join two g on g.p = m.q and g.w = m.p left join three on m.pair_state and three.q = m.q and three.p = m.p and three.w = m.w
), class as (select length(bin(cp)) as class, 1 - (count(*) filter (where c2 = 1) + 1.0::double) / (count(*) + 2) as a from t where not held_out group by 1
), class2 as (select length(bin(cq)) as class, 1 - (count(*) filter (where c3 = 1) + 1.0::double) / (count(*) + 2) as a2 from t where not held_out and pair_state group by 1
), p0 as (select t.*, a, a2, (c + 0.5::double) / (n + 0.5::double * (v + 1)) as p_root from t cross join total left join class on class.class = length(bin(cp)) and cp > 0 left join class2 on class2.class = length(bin(cq)) and cq > 0
), p1 as (select *, case when cp > 0 then a * c2 / cp + (1 - a) * p_root else p_root end as p_one from p0
), s as (select r, count(*) as n_tokens, count(*) filter (where c > 0) as n_known, round(fsum(log10(p_root)), 6) as base_score, round(fsum(log10(case when cq > 0 then a2 * c3 / cq + (1 - a2) * p_one else p_one end)), 6) as score from p1 group by r)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, base_score, score from d join s using (r) cross join total
"""
