"""Operator 8, media columns: Netpbm and BMP to arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width in samples of the images that hold payloads.
ROW = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey 8-bit image as binary PGM."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey 8-bit image as an uncompressed BMP with a grey palette, rows bottom-up."""
    h, w = pixels.shape
    pitch = -(-w // 4) * 4
    body = np.zeros((h, pitch), np.uint8)
    body[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 54 + 1024
    i4 = lambda *v: np.array(v, "<i4").tobytes()
    i2 = lambda *v: np.array(v, "<i2").tobytes()
    head = b"BM" + i4(start + body.size, 0, start) + i4(40, w, h) + i2(1, 8) + i4(0, body.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """Whitespace-separated header numbers after the magic; comments run to the line's end."""
    out, at = [], 2
    for _ in range(count):
        m = re.compile(rb"(?:\s+|#[^\n\r]*[\n\r])+(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, samples up to 16 bits, as (h, w) or (h, w, 3); bitmaps become 0 (ink) and 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not Netpbm")
    bitmap, plain, bands = kind in b"14", kind in b"123", 3 if kind in b"36" else 1
    nums, at = _netpbm_fields(data, 2 if bitmap else 3)
    w, h = nums[:2]
    top = 1 if bitmap else nums[2]
    if not 0 < top < 65536:
        raise ValueError("bad maximum value")
    if bitmap and plain:
        flat = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[: w * h] - ord("0")
    elif plain:
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[: w * h * bands], dtype=np.int64)
    elif bitmap:
        pitch = -(-w // 8)
        rows = np.frombuffer(data, np.uint8, h * pitch, at + 1).reshape(h, pitch)
        flat = np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * bands, at + 1)
    if flat.size != w * h * bands:
        raise ValueError("too few samples")
    if bitmap:
        flat = (1 - flat) * 255
    kind_out = np.uint8 if top <= 255 else np.uint16
    return flat.astype(kind_out).reshape((h, w, 3) if bands == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits; grey palettes give (h, w), others (h, w, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    num = lambda at, kind="<i4": int(np.frombuffer(data, kind, 1, at)[0])
    start, head, w, h = num(10), num(14), num(18), num(22)
    bits, packed, used = num(28, "<u2"), num(30), num(46)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    pitch = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * pitch, start).reshape(abs(h), pitch)
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
        rgb = palette[rows[:, :w]]
        return rgb[..., 0].copy() if (palette == palette[:, :1]).all() else rgb
    step = bits // 8
    return rows[:, : w * step].reshape(abs(h), w, step)[..., 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma by the integer weights 299, 587, 114; grey images pass."""
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, fractions included, from an integral image, of which only the rows at the edges are kept."""
    h, w = image.shape
    if not h or not w:
        raise ValueError("empty image")

    def cut(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * size / parts
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    ly, fy = cut(h, height)
    lx, fx = cut(w, width)
    # The integral image at the target's row edges only: column sums above them, then sums along each of these rows.
    need = np.unique(np.concatenate([ly, ly + 1]))
    bands = np.add.reduceat(image, need[need < h], axis=0, dtype=np.int64)
    above = np.concatenate([np.zeros((1, w)), bands.cumsum(0)])
    rows = above[np.searchsorted(need, ly)] * (1 - fy)[:, None] + above[np.searchsorted(need, ly + 1)] * fy[:, None]
    total = np.zeros((height + 1, w + 1))
    total[:, 1:] = rows.cumsum(1)
    both = total[:, lx] * (1 - fx) + total[:, lx + 1] * fx
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each pixel of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """A side x side uint8 reduction in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_image(data: bytes) -> np.ndarray:
    """Bytes, zero-padded to a positive multiple of ROW, as rows of ROW samples."""
    size = max(1, -(-len(data) // ROW)) * ROW
    return np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)


def image_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", tile: int = 16) -> DataFrame:
    """Store each text as an image and describe what is read back from it.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (the
    stored bytes), media_bytes, media_sha256, tile (NPY bytes) and feature (the
    difference hash).  A null or empty text is one row of zeros.  Equal texts
    give equal values; repeated and null ids keep their own rows.  An empty table
    gives no row; columns of the input other than the id are not returned, so they
    may have any name.  Works batch by batch without a shuffle.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(len(batch) * 4_000_000 / max(1, batch.nbytes)))  # few large texts at once
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                rows = []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode("utf-8", "surrogatepass")
                    media = encode(payload_image(data))
                    image = decode(media)
                    back = image.tobytes()
                    rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), media, len(media), hashlib.sha256(media).hexdigest(), npy_tile(image, tile), difference_hash(image)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    names = ["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "tile", "feature"]
    schema = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, tile binary, feature string"
    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_images(images: DataFrame, id_col: str = "id", bytes_col: str = "bytes", tile: int = 16) -> DataFrame:
    """Describe a column of Netpbm and BMP files: id, height, width, bands, tile (NPY bytes), feature (difference hash), error.

    A null, empty, broken or unknown image is a row of nulls with the reason in
    ``error``; for all others that is null.  Repeated and null ids keep their own
    rows, an empty table gives an empty one, other columns play no part.  Works
    image by image without a shuffle.
    """

    def describe(data: bytes | None) -> tuple:
        try:
            if not data:
                raise ValueError("no image")
            image = decode(data)
            return image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy_tile(image, tile), difference_hash(image), None
        except (ValueError, IndexError, OverflowError) as e:
            return None, None, None, None, None, str(e) or "broken image"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(len(batch) * 16_000_000 / max(1, batch.nbytes)))  # few large images at once
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                cols = zip(*(describe(x.as_py()) for x in part.column(1)), strict=True)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_id", "height", "width", "bands", "tile", "feature", "error"])

    src = images.select(F.col(id_col).alias("_id"), F.col(bytes_col).cast("binary").alias("_bytes"))
    schema = f"_id {src.schema['_id'].dataType.simpleString()}, height int, width int, bands int, tile binary, feature string, error string"
    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
