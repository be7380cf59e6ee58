import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import media


def brute_resize(image, rows, columns):
    high, wide = image.shape
    out = np.zeros((rows, columns))
    share = lambda a, b, i: max(Fraction(0), min(b, i + 1) - max(a, i))
    for r in range(rows):
        for c in range(columns):
            top, bottom, left, right = Fraction(r * high, rows), Fraction((r + 1) * high, rows), Fraction(c * wide, columns), Fraction((c + 1) * wide, columns)
            total = sum(int(image[y, x]) * share(top, bottom, y) * share(left, right, x) for y in range(high) for x in range(wide))
            out[r, c] = float(total / ((bottom - top) * (right - left)))
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 12), st.integers(1, 12), st.integers(0, 9))
def test_area_resize(high, wide, rows, columns, seed):
    image = np.random.default_rng(seed).integers(0, 256, (high, wide)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, rows, columns), brute_resize(image, rows, columns))


def test_formats():
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_pgm(image[:, :, 0])) == image[:, :, 0]).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + image.tobytes()) == image).all()
    assert (media.decode(b"P3\n7 5 255 " + b" ".join(b"%d" % v for v in image.reshape(-1))) == image).all()
    assert (media.decode(b"P2 2 1 999\n999 3") == [[999, 3]]).all()
    assert (media.decode(b"P1 3 2\n101\n0 1 0") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 255, 0], [255, 0, 255]]).all()
    for broken in (None, b"", b"P5", b"P5 3 3 255\n12", b"BM", b"GIF89a", media.encode_bmp(image)[:60]):
        assert media.decode(broken) is None


def test_what_is_no_whole_image(spark):
    rgb = np.zeros((2, 2, 3), np.uint8)
    bmp = media.encode_bmp(rgb)
    with_width = lambda w, h: bmp[:18] + w.to_bytes(4, "little", signed=True) + h.to_bytes(4, "little", signed=True) + bmp[26:]
    broken = [b"P5 0 0 255\n", b"P5 0 3 255\n", b"P5 -1 3 255\n", b"P1 2 1\n79", b"P1 2 1\n1", b"P2 1 1 255\n300", b"P2 1 1 0\n0", b"P2 1 1 70000\n1", b"P2 2 1 9\n1", b"P2 1 1 9\n-1", b"P5 1 1 9\n\x0a", b"P5 1 1 300\n\xff\xff", b"P3 1 1 255 1 2", b"P4 9 1\n\x00", b"P5 1 1 255", b"P2 1 1 255 " + b"9" * 5000, b"P5 " + b"9" * 5000 + b" 1 255\n", b"P5 99999999999 99999999999 255\n0", b"P7", b"P", with_width(-2, 2), with_width(0, 2), with_width(2, 0), with_width(2**31 - 1, 2**31 - 1), bmp[:-1], bmp[:20]]
    assert [media.decode(x) for x in broken] == [None] * len(broken)
    assert media.decode(with_width(2, -2)).shape == (2, 2, 3)
    rows = media.tiled(spark.createDataFrame([(i, x) for i, x in enumerate(broken)], "doc_id long, media binary"), "doc_id", "media").collect()
    assert [(r.height, r.width, r.tile_npy, r.image_hash) for r in rows] == [(None, None, [], None)] * len(broken)


def brute_hash(image):
    cells = brute_resize(image, 8, 9)
    bits = "".join("1" if a < b else "0" for row in cells for a, b in zip(row, row[1:]))
    return f"{int(bits, 2):016x}"


def test_the_feature_in_plain_code(spark):
    texts = ["", "abc", "some words " * 90, "é" * 400]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), side=24).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        image = np.array(list(raw), np.uint8).reshape(-1, 24)
        parts = "".join(brute_hash(image[k : k + 24]) for k in range(0, len(image), 24))
        assert got[i].feature == f"{brute_hash(image)}:{hashlib.sha256(parts.encode()).hexdigest()[:16]}"
        assert got[i].same and got[i].bmp_bytes == 54 + len(raw)


def test_query_rows(spark):
    texts = [None, "", "abc", "abc", "é" * 700, "x" * 576, "long text " * 9000]
    df = spark.createDataFrame([(None if i == 2 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = sorted(media.features(df).collect(), key=lambda r: (r.n_bytes, str(r.doc_id)))
    assert len(got) == len(texts)
    for t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        mine = [r for r in got if r.n_bytes == len(raw)]
        assert {(r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in mine} == {(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())}
        assert len({r.feature for r in mine}) == 1
    assert media.features(df.limit(0)).count() == 0


def test_tiles_hold_the_image(spark):
    df = media.stored(spark.createDataFrame([(1, "some text " * 2000), (2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in media.tiled(df, "doc_id", "media", 100).collect()}
    whole = np.concatenate([np.load(io.BytesIO(bytes(b))) for b in rows[1].tile_npy])
    assert whole.tobytes().rstrip(b"\xff") == b"some text " * 2000
    assert (rows[1].height, rows[1].width) == whole.shape and len(rows[1].tile_hash) == len(rows[1].tile_npy)
    broken = spark.createDataFrame([(1, b"nothing"), (2, None)], "doc_id long, media binary")
    assert [(r.height, r.tile_npy) for r in media.tiled(broken, "doc_id", "media").collect()] == [(None, []), (None, [])]
