"""Media columns: Netpbm (P1 to P6) and BMP images decoded to numpy arrays, area-resized, hashed and written as NPY tiles.

Resizing averages exactly over each target cell's area, fractional pixels included: the integral image (two cumulative sums) is
bilinear within a pixel, so its values at fractional borders are exact, and a cell is four of them. The difference hash
compares neighbours of the grey image resized to 9 x 8, row by row, 64 bits.

Result: width, height, channels, tile (the bytes of an NPY file, uint8, rows x columns x 3), dhash (64 bits as a signed number), error.

Defined results: null bytes give nulls and the error "null"; empty, truncated or unknown images give nulls and a reason; samples of more than 8
bits are scaled to 8; numbers of more than 9 digits are errors; BMP alpha is dropped, and palettes are applied; images of any size count whole; ties of neighbours give the bit 0;
repeated rows are treated alike; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import c, ensure_workers, fresh

TILE = 32
_token = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
_comment = re.compile(rb"#[^\n]*")


class BadImage(ValueError):
    pass


def netpbm(data: bytes) -> np.ndarray:
    kind, at = data[1:2], 2
    bits = kind in b"14"
    numbers = []
    for _ in range(2 if bits else 3):
        m = _token.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise BadImage("no header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, most = (*numbers, 1)[:3]
    if not w or not h or not 0 < most < 65536:
        raise BadImage("bad size")
    channels = 3 if kind in b"36" else 1
    n = w * h * channels
    if kind in b"123":
        body = _comment.sub(b" ", data[at:])
        try:
            if kind == b"1":
                a = np.frombuffer(re.sub(rb"\s+", b"", body), np.uint8)[:n].astype(np.int64) - 48
            else:
                words = body.split(None, min(n, len(body)))[:n]
                if not all(x.isdigit() and len(x) < 10 for x in words):
                    raise BadImage("sample out of range")
                a = np.array(words, np.int64)
        except (ValueError, OverflowError):
            raise BadImage("no number") from None
    elif kind == b"4":
        row = (w + 7) // 8
        a = np.frombuffer(data, np.uint8, offset=at + 1)[: row * h] if len(data) > at + 1 else np.empty(0, np.uint8)
        if len(a) < row * h:
            raise BadImage("truncated")
        a = np.unpackbits(a.reshape(h, row), axis=1)[:, :w].ravel()
    else:
        a = np.frombuffer(data[at + 1 :][: n * (1 + (most > 255))], ">u2" if most > 255 else np.uint8) if (len(data) - at - 1) // (1 + (most > 255)) >= n else np.empty(0)
    if len(a) < n:
        raise BadImage("truncated")
    a = a[:n]
    if bits:
        a = (1 - a) * 255
    elif most != 255:
        a = (a.astype(np.int64) * 255 + most // 2) // most
    if len(a) and (a.min() < 0 or a.max() > 255):
        raise BadImage("sample out of range")
    return a.astype(np.uint8).reshape(h, w, channels)


def bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise BadImage("truncated")
    offset, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        w, h, _, depth = struct.unpack_from("<HHHH", data, 18)
        packing, used = 0, 0
    elif size >= 40 and len(data) >= 54:
        w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
        used = struct.unpack_from("<I", data, 46)[0]
    else:
        raise BadImage("unknown header")
    down, h = h < 0, abs(h)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or packing == 3 and depth != 32:
        raise BadImage("unknown packing")
    if w <= 0 or not h:
        raise BadImage("bad size")
    row = (w * depth + 31) // 32 * 4
    if len(data) < offset + row * h:
        raise BadImage("truncated")
    a = np.frombuffer(data, np.uint8, row * h, offset).reshape(h, row)
    if depth <= 8:
        step, n = (3 if size == 12 else 4), used or 1 << depth
        if len(data) < 14 + size + step * n:
            raise BadImage("truncated")
        palette = np.frombuffer(data, np.uint8, step * n, 14 + size).reshape(n, step)[:, 2::-1]
        index = a[:, :w] if depth == 8 else np.stack(((a >> 4), (a & 15)), axis=2).reshape(h, -1)[:, :w] if depth == 4 else np.unpackbits(a, axis=1)[:, :w]
        if index.max() >= n:
            raise BadImage("no such colour")
        a = palette[index]
    elif packing == 3:
        pixel = a.reshape(h, -1).view("<u4")[:, :w]
        if len(data) < 66:
            raise BadImage("truncated")
        masks = struct.unpack_from("<III", data, 54)
        if not all(masks):
            raise BadImage("bad masks")
        parts = []
        for m in masks:
            low = (m & -m).bit_length() - 1
            top = m >> low
            parts.append((((pixel & np.uint32(m)) >> np.uint32(low)).astype(np.int64) * 255 + top // 2) // top)
        a = np.stack(parts, axis=2).astype(np.uint8)
    else:
        step = depth // 8
        a = a[:, : w * step].reshape(h, w, step)[:, :, 2::-1]
    return a if down else a[::-1]


def decode(data: bytes) -> np.ndarray:
    """uint8 array of rows x columns x channels."""
    if not data:
        raise BadImage("empty")
    if data[:2] == b"BM":
        return bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return netpbm(data)
    raise BadImage("unknown format")


def integral(a: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def resized(total: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area averages of an h x w grid, from the integral image."""
    for axis, n in ((0, h), (1, w)):
        size = total.shape[axis] - 1
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(total.ndim)])
        total = np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part
        total = np.diff(total, axis=axis) * (n / size)
    return total


def grey(a: np.ndarray) -> np.ndarray:
    return a[..., 0] if a.shape[-1] == 1 else a @ np.array([0.299, 0.587, 0.114])


def dhash(total: np.ndarray) -> int:
    """Bit 8 y + x says that the grey cell (x + 1, y) is brighter than (x, y)."""
    g = np.round(grey(resized(total, 8, 9)), 6)
    bits = np.packbits(g[:, 1:] > g[:, :-1], bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), version=(1, 0))
    return out.getvalue()


def process(data: bytes | None, tile: int = TILE) -> tuple:
    """width, height, channels, tile, dhash, error."""
    if data is None:
        return None, None, None, None, None, "null"
    try:
        a = decode(data)
    except BadImage as e:
        return None, None, None, None, None, str(e)
    total = integral(a)
    small = np.rint(resized(total, tile, tile)).astype(np.uint8)
    if small.shape[2] == 1:
        small = np.repeat(small, 3, axis=2)
    return a.shape[1], a.shape[0], a.shape[2], npy(small), dhash(total), None


def media_columns(rows: DataFrame, image: str = "image", tile: int = TILE) -> DataFrame:
    """rows with width, height, channels, tile, dhash and error in place of the image."""
    ensure_workers(rows.sparkSession)
    kept = [x for x in rows.columns if x.lower() != image.lower()]
    kinds = [("width", pa.int32(), "integer"), ("height", pa.int32(), "integer"), ("channels", pa.int32(), "integer"), ("tile", pa.binary(), "binary"), ("dhash", pa.int64(), "long"), ("error", pa.string(), "string")]
    given = rows.select(*[c(x) for x in kept], c(image).cast("binary").alias("image"))
    names = fresh(given, *[x for x, _, _ in kinds])
    schema = given.select(*[c(x) for x in kept]).schema
    for n, (_, _, kind) in zip(names, kinds):
        schema = type(schema)(list(schema.fields)).add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [process(b, tile) for b in part.column(part.num_columns - 1).to_pylist()]
                columns = part.columns[:-1] + [pa.array([f[k] for f in found], kind) for k, (_, kind, _) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, kept + names)

    return given.mapInArrow(run, schema)


def documents_as_images(docs: DataFrame) -> DataFrame:
    """doc_id, image: the bytes of each text as pixels; a PGM, PPM, PBM or BMP by doc_id."""
    data = F.encode(F.col("text"), "UTF-8")
    size = F.octet_length("text")
    kind = F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0))

    def raster(row: int):
        h = F.greatest(F.ceil(size / row), F.lit(1))
        return h, F.expr(f"rpad(encode(text, 'UTF-8'), cast(greatest(ceil(octet_length(text) / {row}), 1) * {row} as int), X'20')")

    def little(x):
        return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x.cast("long")), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))

    def header(form: str, w: int, h):
        return F.encode(F.format_string(form, F.lit(w), h), "UTF-8")

    h64, r64 = raster(64)
    h96, r96 = raster(96)
    zero = F.unhex(F.lit("00000000"))
    head = F.concat(F.unhex(F.lit("424D")), little(h96 * 96 + 54), zero, little(F.lit(54)), little(F.lit(40)), little(F.lit(32)), little(h96), F.unhex(F.lit("01001800")), zero, little(h96 * 96), zero, zero, zero, zero)
    image = F.when(kind == 0, F.concat(header("P5\n%d %d\n255\n", 64, h64), r64)).when(kind == 1, F.concat(header("P6\n%d %d\n255\n", 32, h96), r96)).when(kind == 2, F.concat(header("P4\n%d %d\n", 512, h64), r64)).otherwise(F.concat(head, r96))
    return docs.select("doc_id", F.when(data.isNotNull(), image).alias("image"))
