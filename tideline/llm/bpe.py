"""Byte-level BPE: vectorised pre-tokenisation without a regex engine, cached pair merging, and decoding.

A batch of texts becomes one array of code points. Each code point gets a class, and a class looks ahead where the
pattern does: the last white space of a run, an apostrophe with a contraction's letters behind it. Then the pattern is
an automaton of eight states, and a symbol is a function from state to state. Such functions compose associatively, so
the states of a whole batch come from a scan in blocks: all blocks compose their functions side by side, the block
functions are chained, and a second sweep fills in the states. A new piece begins where state and symbol say so.

Defined results: null and empty texts give no ids, and decode to no bytes; texts of any length are encoded whole;
equal texts give equal ids; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import runtime

# Unicode's White_Space code points.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: letter, number, other, white space that more white space or the end follows, a space that is the last
# of its run, other white space that is the last of its run, an apostrophe before one contraction letter or two, and
# the first code point of a text, which is one of the others plus FIRST.
LETTER, NUMBER, OTHER, WHITE, SPACE, LAST, ONE, TWO, FIRST = range(9)
# States: nothing open, in letters, in numbers, in others, after a space that joins what follows, in white space,
# in a contraction with one or two letters to come.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state; symbols from FIRST on begin a piece anyway."""
    step = np.zeros((2 * FIRST, STATES), np.uint8)
    begins = np.ones((2 * FIRST, STATES), bool)
    enter = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, WHITE: IN_WHITE, SPACE: JOINING, LAST: DONE, ONE: ONE_LEFT, TWO: TWO_LEFT}
    for symbol, state in enter.items():
        step[symbol], step[symbol + FIRST] = state, state
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (WHITE, IN_WHITE)):
        begins[symbol, state] = False
        if symbol != WHITE:
            begins[symbol, JOINING] = False
    for symbol in (ONE, TWO):  # inside other characters an apostrophe is one of them
        for state in (IN_OTHERS, JOINING):
            step[symbol, state], begins[symbol, state] = IN_OTHERS, False
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, DONE
    begins[LETTER, TWO_LEFT] = begins[LETTER, ONE_LEFT] = False
    return step, begins


STEP, BEGINS = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = WHITE
    return table


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; first marks the beginnings of texts."""
    n = len(points)
    kind = _classes()[points]
    ends = np.ones(n, bool)  # the last of its text
    ends[:-1] = first[1:]
    white = kind == WHITE
    next_white = np.ones(n, bool)
    next_white[:-1] = white[1:]
    last = white & ~next_white & ~ends
    kind[last] = np.where(points[last] == 0x20, SPACE, LAST)
    for i in np.flatnonzero(points == 0x27):
        room = n - i - 1
        if room < 1 or ends[i]:
            continue
        a = points[i + 1]
        if a in _SHORT:
            kind[i] = ONE
        elif room >= 2 and not ends[i + 1] and (int(a), int(points[i + 2])) in _LONG:
            kind[i] = TWO
    return kind + FIRST * first.astype(np.uint8)


# The pattern's contractions, of one letter and of two.
_SHORT = {ord(c) for c in "stmd"}
_LONG = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The state before each symbol, from a scan that composes the symbols' functions block by block."""
    n = len(symbol)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    grid = np.full((rows, width), LETTER, np.uint8)
    grid.reshape(-1)[:n] = symbol
    flat = STEP.reshape(-1)
    grid_t = np.ascontiguousarray(grid.T).astype(np.intp) * STATES
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))  # each block's function so far
    for column in grid_t:
        whole = flat[column[:, None] + whole]
    enter = np.zeros(rows, np.uint8)
    for r in range(1, rows):
        enter[r] = whole[r - 1, enter[r - 1]]
    before = np.empty((width, rows), np.uint8)
    state = enter
    for k, column in enumerate(grid_t):
        before[k] = state
        state = flat[column + state]
    return np.ascontiguousarray(before.T).reshape(-1)[:n]


def pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts joined, the byte offsets where pieces begin (and the end), and the number of pieces of each text."""
    joined = b"".join(texts)
    points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
    if not len(points):
        return joined, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each code point begins
    text_ends = np.cumsum([len(t) for t in texts])
    text_starts = text_ends - [len(t) for t in texts]
    first = np.zeros(len(points), bool)
    first[np.searchsorted(at, text_starts[text_starts < text_ends])] = True
    symbol = symbols(points, first)
    start = BEGINS.reshape(-1)[symbol.astype(np.intp) * STATES + states_before(symbol)]
    starts = at[start]
    count = np.searchsorted(starts, text_ends) - np.searchsorted(starts, text_starts)
    return joined, np.append(starts, len(joined)), count


class Coder:
    """Encodes and decodes by the ranks of one file."""

    #: So many distinct pieces are remembered; then memory starts afresh. It holds results only, so it changes none.
    REMEMBERED = 300_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merged_long(parts)
        none, get = 1 << 60, ranks.get
        pair = [get(piece[i : i + 2], none) for i in range(len(parts) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same for long pieces, with a heap over linked parts: n log n instead of n squared."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, prior = [*range(1, n), -1], [-1, *range(n - 1)]
        gone = bytearray(n)
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], gone[j], after[i] = pair, 1, after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for k in (prior[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k] + parts[after[k]]))
        return tuple(ranks[p] for i, p in enumerate(parts) if not gone[i])

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(piece) <= 64:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[np.ndarray]]:
        """The ids of each text, and for each piece of it the byte offset in the text where it begins."""
        joined, offsets, count = pieces(texts)
        cut = offsets.tolist()
        out, at, k, begin = [], [], 0, 0
        of = self.ids_of
        for text, n in zip(texts, count.tolist(), strict=True):
            ids: list[int] = []
            for a, b in zip(cut[k : k + n], cut[k + 1 : k + n + 1]):
                ids += of(joined[a:b])
            out.append(ids)
            at.append(offsets[k : k + n] - begin)
            k += n
            begin += len(text)
        return out, at

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def coder(path: str) -> Coder:
    """One for each process and file."""
    return Coder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ids array<long>, piece_starts array<long> (byte offsets of the pieces in the text).

    path: a rank file that every executor can read at this place. Null ids stay null.
    """

    def kernel(texts: list[bytes]) -> dict[str, list]:
        ids, at = coder(path).encode(texts)
        return {"ids": ids, "piece_starts": [a.tolist() for a in at]}

    return runtime.map_rows(df, [id_col], text_col, kernel, "ids array<long>, piece_starts array<long>")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id column, n_tokens, n_pieces, digests of the ids and of the bytes that they decode to, and ids if asked.

    Without ids only digests leave the task, so the ids take no space in a shuffle or a table.
    """

    def kernel(texts: list[bytes]) -> dict[str, list]:
        made = coder(path)
        ids, at = made.encode(texts)
        return {
            "n_tokens": [len(x) for x in ids],
            "n_pieces": [len(x) for x in at],
            "ids_sha256": [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(made.decode(x)).hexdigest() for x in ids],
            "ids": ids,
        }

    return runtime.map_rows(df, [id_col], text_col, kernel, "n_tokens long, n_pieces long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every whole text of documents."""
    return round_trip(runtime.table(spark, sf_dir, "documents", "doc_id", "text"), rank_file())
