import io
import random
import struct

import numpy as np
import pytest

from lucidframe.llm import media as M


def pnm(kind, a, most=255):
    h, w = a.shape[:2]
    head = f"P{kind}\n# a comment\n{w} {h}\n".encode()
    if kind in (1, 4):
        bits = (a[..., 0] == 0).astype(np.uint8)
        return head + (b"\n".join(" ".join(map(str, r)).encode() for r in bits) if kind == 1 else np.packbits(bits, axis=1).tobytes())
    head += f"{most}\n".encode()
    v = a.reshape(h, -1)
    if kind in (2, 3):
        return head + b"\n".join(" ".join(map(str, r)).encode() for r in v)
    return head + (v.astype(">u2") if most > 255 else v.astype(np.uint8)).tobytes()


def bmp(a, depth=24, down=False):
    h, w = a.shape[:2]
    rows = a if down else a[::-1]
    palette = b""
    if depth >= 24:
        px = np.full((h, w, depth // 8), 255, np.uint8)
        px[..., :3] = rows[..., ::-1]
        raw = [r.tobytes() for r in px]
    else:
        colours = [tuple(c) for c in np.unique(a.reshape(-1, 3), axis=0)]
        palette = b"".join(bytes((c[2], c[1], c[0], 0)) for c in colours).ljust(4 << depth, b"\0")
        index = np.array([[colours.index(tuple(p)) for p in r] for r in rows], np.uint8)
        if depth == 8:
            raw = [r.tobytes() for r in index]
        elif depth == 4:
            raw = [bytes((r[i] << 4) | (r[i + 1] if i + 1 < w else 0) for i in range(0, w, 2)) for r in index]
        else:
            raw = [np.packbits(r).tobytes() for r in index]
    raw = [r + b"\0" * (-len(r) % 4) for r in raw]
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(palette) + sum(map(len, raw)), 0, 54 + len(palette), 40, w, -h if down else h, 1, depth, 0, 0, 0, 0, 0, 0) + palette + b"".join(raw)


def test_formats_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(15):
        h, w = rng.integers(1, 40, 2)
        grey, rgb = rng.integers(0, 256, (h, w, 1)), rng.integers(0, 256, (h, w, 3))
        black = (rng.random((h, w, 1)) < 0.5) * 255
        for kind, a in ((1, black), (2, grey), (3, rgb), (4, black), (5, grey), (6, rgb)):
            assert (M.decode(pnm(kind, a)) == a).all()
        few = rng.integers(0, 2, (h, w, 1)) * np.array([200, 90, 30]) + np.array([5, 6, 7])
        for depth, a in ((24, rgb), (32, rgb), (8, few), (4, few), (1, few)):
            for down in (False, True):
                assert (M.decode(bmp(a, depth, down)) == a).all()
        wide = rng.integers(0, 1000, (h, w, 1))
        assert (M.decode(pnm(5, wide, 999)) == (wide * 255 + 499) // 999).all()


def by_hand(a, h, w):
    """Area averages with every pixel's share of every cell."""
    out = np.zeros((h, w, a.shape[2]))
    share = lambda i, n, size: [(p, min(p + 1, (i + 1) * size / n) - max(p, i * size / n)) for p in range(size) if min(p + 1, (i + 1) * size / n) > max(p, i * size / n)]
    for y in range(h):
        for x in range(w):
            parts = [(a[p, q], s * t) for p, s in share(y, h, a.shape[0]) for q, t in share(x, w, a.shape[1])]
            out[y, x] = sum(v * s for v, s in parts) / sum(s for _, s in parts)
    return out


def test_resize_as_by_hand():
    rng = np.random.default_rng(2)
    for h, w, th, tw in ((7, 5, 3, 4), (3, 2, 8, 9), (1, 1, 4, 4), (16, 16, 4, 4), (10, 33, 8, 9)):
        a = rng.integers(0, 256, (h, w, 3))
        assert np.abs(M.resized(M.integral(a), th, tw) - by_hand(a, th, tw)).max() < 1e-6


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(0, 180, 2, dtype=np.int64)[None, :, None], (64, 1, 1))
    assert M.process(pnm(5, ramp))[4] == -1 and M.process(pnm(5, ramp[:, ::-1]))[4] == 0 and M.process(pnm(5, ramp * 0 + 7))[4] == 0
    a = np.random.default_rng(3).integers(0, 256, (50, 70, 3))
    w, h, ch, tile, hashed, error = M.process(pnm(6, a))
    assert (w, h, ch, error) == (70, 50, 3, None)
    t = np.load(io.BytesIO(tile))
    assert t.shape == (32, 32, 3) and t.dtype == np.uint8 and np.abs(t - by_hand(a, 32, 32)).max() <= 0.5 + 1e-6
    g = by_hand(a, 8, 9) @ np.array([0.299, 0.587, 0.114])
    assert hashed == int.from_bytes(sum(int(g[y, x + 1] > g[y, x]) << (8 * y + x) for y in range(8) for x in range(8)).to_bytes(8, "little"), "little", signed=True)


def test_broken_images():
    good = [pnm(6, np.zeros((4, 4, 3), int)), bmp(np.zeros((4, 4, 3), int)), bmp(np.zeros((4, 4, 3), int), 8), pnm(4, np.zeros((4, 4, 1), int))]
    rng = random.Random(1)
    for data in good:
        assert M.process(data)[5] is None
        for n in range(len(data)):
            out = M.process(data[:n])
            assert out[5] is not None or out[0]
        for _ in range(300):
            b = bytearray(data)
            b[rng.randrange(min(60, len(b)))] = rng.randrange(256)
            M.process(bytes(b))
    assert M.process(None)[5] == "null" and M.process(b"")[5] == "empty" and M.process(b"GIF89a")[5] == "unknown format"


def test_numbers_and_headers_that_no_image_has():
    wide = (1 << 31) - 1
    odd = [b"P2\n2 1\n255\n1 " + b"9" * 23, b"P2\n" + b"9" * 5000 + b" 1\n255\n1", b"P5\n999999999 999999999\n255\nxx", b"P3\n1 1\n255\n1 -2 3", b"P2\n1 1\n255\n1_0", b"P1\n2 1\n1 \xff", b"P4\n999999999 999999999\nx", b"P6\n1 1\n99999\nabc", b"P2\n3 1\n255\n1 2"]
    head = lambda size, w, h, depth, packing: b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, size, w, h, 1, depth, packing, 0, 0, 0, 0, 0)
    odd += [head(40, 1, 1, 32, 3) + b"abcd", head(40, wide, wide, 24, 0) + b"abcd", head(40, 1, -wide - 1, 32, 3) + b"abcd", head(40, 1, 1, 8, 0) + b"abcd", head(40, -5, 1, 24, 0), head(13, 1, 1, 24, 0) + b"abcd"]
    for data in odd:
        assert M.process(data)[:5] == (None,) * 5 and M.process(data)[5], data[:40]
    rng = random.Random(7)
    good = [pnm(k, np.zeros((3, 5, 3 if k in (3, 6) else 1), int)) for k in range(1, 7)] + [head(40, 1, 1, 32, 3) + struct.pack("<III", 255, 65280, 1 << 31) + b"abcd"]
    for data in good:
        for _ in range(300):
            b = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(min(70, len(b)))] = rng.choice([0, 45, 48, 57, 57, 57, 255, rng.randrange(256)])
            M.process(bytes(b))


def test_media_table(spark):
    a = np.random.default_rng(4).integers(0, 256, (9, 9, 3))
    rows = [(1, bytearray(pnm(6, a)), "t"), (2, None, "t"), (3, bytearray(b""), "t"), (None, bytearray(bmp(a)), None), (1, bytearray(pnm(6, a)), "t")]
    out = M.media_columns(spark.createDataFrame(rows, "doc_id long, image binary, tile string"))
    assert out.columns == ["doc_id", "tile", "width", "height", "channels", "_tile", "dhash", "error"]
    got = out.collect()
    assert len(got) == 5 and len({(bytes(r["_tile"]), r.dhash) for r in got if r.error is None}) == 1
    assert sorted(r.error for r in got if r.error) == ["empty", "null"]
    assert M.media_columns(spark.createDataFrame([], "image binary")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_documents_as_images_hold_the_whole_text(spark, n):
    text = ("xyzé" * n)[:n]
    rows = M.documents_as_images(spark.createDataFrame([(i, text) for i in range(4)] + [(9, None), (None, text)], "doc_id long, text string")).collect()
    for r in rows:
        if r.doc_id == 9:
            assert r.image is None
            continue
        a = M.decode(bytes(r.image))
        raw = text.encode()
        kind = (r.doc_id or 0) % 4
        data = np.packbits(a[..., 0] == 0, axis=1).tobytes() if kind == 2 else (a[::-1, :, ::-1] if kind == 3 else a).astype(np.uint8).tobytes()
        assert data[: len(raw)] == raw and set(data[len(raw) :]) <= {32}
