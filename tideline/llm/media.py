"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, written as NPY tiles.

Defined results: null bytes, and bytes that are no whole image of the formats below (a size of zero or less, a maximum out
of 1 to 65535, samples over the maximum, too few of them, a colour that the palette lacks), decode to None and give a row
with null size and no tiles; images of any size are worked through in bands of rows, so memory is bounded by one image and a
band; equal bytes give equal tiles and hashes; repeated rows each give rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import runtime

#: The contract's payload unit is one square of 24 x 24 samples.
WIDTH = 24
UNIT = WIDTH * WIDTH
#: A difference hash compares neighbours in a grid of 8 rows and 9 columns.
HASH_ROWS, HASH_COLUMNS = 8, 9


def encode_pgm(image: np.ndarray) -> bytes:
    """An 8-bit grey image in Netpbm's binary form."""
    rows, columns = image.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP, bottom row first, rows padded to four bytes; image is rows x columns x 3 (red, green, blue)."""
    rows, columns, _ = image.shape
    stride = -(-columns * 3 // 4) * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, : columns * 3] = image[::-1, :, ::-1].reshape(rows, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, columns, rows, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def _header(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """So many decimal numbers, with white space and comments between; and where they end."""
    found: list[int] = []
    while len(found) < count:
        c = data[at : at + 1]
        if c == b"#":
            at = data.index(b"\n", at)
        elif c.isspace():
            at += 1
        else:
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            found.append(int(data[at:end]))
            at = end
    return found, at


def _require(good: bool) -> None:
    if not good:
        raise ValueError("not a whole image")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: rows x columns, or rows x columns x 3; samples are 16-bit where the maximum is over 255."""
    kind = data[1] - 48
    numbers, at = _header(data, 2, 2 if kind in (1, 4) else 3)
    columns, rows = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    size = rows * columns * depth
    _require(rows > 0 and columns > 0 and 1 <= top <= 65535 and data[at : at + 1].isspace())
    if kind == 1:
        bits = np.frombuffer(data[at:].translate(None, b" \t\r\n\x0b\x0c"), np.uint8)[:size] - 48
        _require(len(bits) == size and bits.max() <= 1)
        image = 255 * (1 - bits)
    elif kind in (2, 3):
        samples = data[at:].split(None, size)[:size]
        _require(len(samples) == size and all(x.isdigit() and len(x) <= 9 for x in samples))
        image = np.array(samples, dtype=np.int64)
    elif kind == 4:
        stride = -(-columns // 8)
        packed = np.frombuffer(data, np.uint8, rows * stride, at + 1).reshape(rows, stride)
        image = 255 * (1 - np.unpackbits(packed, axis=1)[:, :columns])
    else:
        image = np.frombuffer(data, np.dtype(">u2") if top > 255 else np.uint8, size, at + 1)
    _require(kind in (1, 4) or image.max() <= top)
    return image.astype(np.uint16 if top > 255 else np.uint8).reshape((rows, columns) if depth == 1 else (rows, columns, 3))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits: rows x columns x 3."""
    offset, header, columns, rows, _, depth, packing = struct.unpack_from("<10xIIiiHHI", data)
    _require(packing in (0, 3) and depth in (8, 24, 32) and columns > 0 and rows != 0 and offset >= 14 + header >= 54)
    if packing == 3:  # masks, which must be those of plain 32-bit samples
        _require(depth == 32 and struct.unpack_from("<III", data, 54) == (0xFF0000, 0xFF00, 0xFF))
    stride = -(-columns * depth // 32) * 4
    body = np.frombuffer(data, np.uint8, abs(rows) * stride, offset).reshape(abs(rows), stride)
    body = body if rows < 0 else body[::-1]
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        _require(used <= 256)
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)
        return palette[body[:, :columns], 2::-1]
    return body[:, : columns * depth // 8].reshape(abs(rows), columns, depth // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """The image's samples; None for what is not a whole image."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, TypeError, IndexError, OverflowError, struct.error):
        pass
    return None


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image, by integer weights; grey images as they are."""
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(2) // 1000).astype(image.dtype)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of each cell's area, edges cut exactly, from the integral image read at fractional places.

    Sums are integers scaled by the grid (a cell's edges are multiples of 1 / rows and 1 / columns of a sample), so the
    result does not depend on the order of addition.
    """
    high, wide = image.shape
    # integral over rows at the cells' edges: whole rows, then the cut row's share; the same over columns
    by_row = _integral_at(image.astype(np.int64), high, rows)
    both = _integral_at(np.ascontiguousarray(np.diff(by_row, axis=0).T), wide, columns)
    sums = np.diff(both, axis=0).T
    return sums / (high * wide)


def _integral_at(samples: np.ndarray, length: int, cells: int) -> np.ndarray:
    """cells x the integral along the first axis, at the cells' edges k * length / cells."""
    edges = np.arange(cells + 1) * length
    whole, part = edges // cells, edges % cells
    # the integral's differences between edges are all that is needed: sums of whole rows per cell, added up
    totals = np.zeros((cells + 1, samples.shape[1]), np.int64)
    if length:
        starts = np.minimum(whole[:-1], length - 1)
        sums = np.add.reduceat(samples, starts, axis=0)
        sums[whole[1:] == whole[:-1]] = 0
        np.cumsum(sums, axis=0, out=totals[1:])
    cut = samples[np.minimum(whole, length - 1)] * part[:, None]
    return totals * cells + cut


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: a cell of the resized image is darker than its right neighbour."""
    cells = area_resize(grey(image), HASH_ROWS, HASH_COLUMNS)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> list[tuple[int, int, bytes, str]]:
    """Row, column, NPY bytes and difference hash of each square of `side` samples; edge tiles are smaller."""
    return [(r, c, npy(part), difference_hash(part)) for r in range(0, image.shape[0], side) for c in range(0, image.shape[1], side) for part in (image[r : r + side, c : c + side],)]


def as_image(text: bytes) -> np.ndarray:
    """The contract's payload: the bytes and 255s up to a positive multiple of the unit, as rows of WIDTH samples."""
    payload = np.full(max(1, -(-len(text) // UNIT)) * UNIT, 255, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    return payload.reshape(-1, WIDTH)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_bytes, media (the text's payload as a grey Netpbm image)."""

    def kernel(texts: list[bytes]) -> dict[str, list]:
        return {"n_bytes": [len(t) for t in texts], "media": [encode_pgm(as_image(t)) for t in texts]}

    return runtime.map_rows(df, [id_col], text_col, kernel, "n_bytes long, media binary")


def tiled(df: DataFrame, id_col: str, media_col: str, side: int = 256) -> DataFrame:
    """Per image: the id column, height, width, tile_at (row, column, ...), tile_npy as one array, tile_hash, image_hash."""

    def kernel(images: list[bytes]) -> dict[str, list]:
        decoded = [decode(x) for x in images]
        cut = [tiles(x, side) if x is not None else [] for x in decoded]
        return {
            "height": [None if x is None else x.shape[0] for x in decoded],
            "width": [None if x is None else x.shape[1] for x in decoded],
            "tile_at": [[v for r, c, _, _ in t for v in (r, c)] for t in cut],
            "tile_npy": [[b for _, _, b, _ in t] for t in cut],
            "tile_hash": [[h for *_, h in t] for t in cut],
            "image_hash": [None if x is None else difference_hash(x) for x in decoded],
        }

    return runtime.map_rows(df, [id_col], media_col, kernel, "height long, width long, tile_at array<long>, tile_npy array<binary>, tile_hash array<string>, image_hash string")


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 256) -> DataFrame:
    """Per text: the sizes and digests of its payload as read back from the stored image's NPY tiles, and a feature.

    The stored image is decoded, cut into NPY tiles and put together again from them; payload columns and feature come
    from what was read back. feature: the image's difference hash, a colon, and the digest of the tiles' hashes. bmp_bytes
    and bmp_sha256 are of the same payload stored as a BMP of three samples a place, and same says that what is read back
    from that is the payload too.
    """

    def one(text: bytes) -> tuple:
        whole = as_image(text)
        media = encode_pgm(whole)
        image = decode(media)
        cut = tiles(image, side)
        back = np.concatenate([np.load(io.BytesIO(data), allow_pickle=False) for _, _, data, _ in cut])
        payload = back.tobytes()
        marks = hashlib.sha256("".join(h for *_, h in cut).encode()).hexdigest()[:16]
        bmp = encode_bmp(whole.reshape(-1, WIDTH // 3, 3))
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(back)}:{marks}", len(bmp), hashlib.sha256(bmp).hexdigest(), decode(bmp).tobytes() == payload

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bmp_bytes", "bmp_sha256", "same"]

    def kernel(texts: list[bytes]) -> dict[str, list]:
        return dict(zip(names, map(list, zip(*map(one, texts), strict=True)), strict=True))

    return runtime.map_rows(df, [id_col], text_col, kernel, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bmp_bytes long, bmp_sha256 string, same boolean")


def op5_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a Netpbm image, read back through NPY tiles, and hashed."""
    return features(runtime.table(spark, sf_dir, "documents", "doc_id", "text"))
