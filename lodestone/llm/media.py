"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles and difference hashes.

``decode`` reads P1 to P6 Netpbm files and uncompressed 1, 4, 8, 24 and 32 bit
BMP files. ``area_resize`` averages source areas with an integral image, so its
cost does not depend on the ratio of the sizes. ``dhash`` compares neighbouring
cells of a 9 by 8 reduction. ``media_features`` applies them to a binary column
in Arrow batches; one image at a time is in memory.

Samples of other depths are scaled to all of 8 bits, those of more than 8 to all
of 16; a tile has 8 bits in any case.

Defined results: null or undecodable bytes give a row whose other columns are
null (``error`` says why); so do images without rows or columns, headers that
claim more samples than there are bytes for, and samples above the header's
largest. An empty table gives an empty result, repeated rows a row each. For
texts, null counts as empty; an image of any length is held whole, with 16 bytes
a sample while it is resized.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches

TILE = 32
WIDTH = 64
_HEADER = re.compile(rb"\s*(?:#[^\n\r]*[\n\r]\s*)*(\d+)")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit PGM file whose samples are the payload, row by row."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decode(data: bytes) -> np.ndarray:
    """Samples as an array of rows by columns, or by channels too."""
    if data[:1] == b"P":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1:2], 2, []
    if kind not in b"123456" or len(kind) != 1:
        raise ValueError("unknown Netpbm kind")
    while len(head) < (2 if kind in b"14" else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    depth = 3 if kind in b"36" else 1
    _check_size(width, height, width * height * depth, data)
    if not 0 < top < 1 << 16:
        raise ValueError("largest sample out of range")
    if kind in b"123":
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        flat = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8) - 48 if kind == b"1" else np.array(body.split(), np.int64)
        flat = flat[: width * height * depth]
    else:
        at += 1
        if kind == b"4":
            row = -(-width // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
            flat = bits[:, :width].reshape(-1)
        else:
            flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height * depth, at)
    if flat.size != width * height * depth:
        raise ValueError("too few samples")
    if kind in b"14":
        flat = (1 - flat.astype(np.uint8)) * np.uint8(255)  # a set bit is black
    elif top == 255 and flat.dtype == np.uint8:
        pass
    elif flat.min() < 0 or flat.max() > top:
        raise ValueError("a sample out of range")
    else:
        full = 65535 if top > 255 else 255
        flat = np.rint(flat * (full / top)).astype(np.uint16 if top > 255 else np.uint8)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def _check_size(width: int, height: int, samples: int, data: bytes) -> None:
    if width <= 0 or height <= 0:
        raise ValueError("an image without rows or columns")
    if samples > 8 * len(data):  # one bit a sample at least
        raise ValueError("too few samples")


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP files")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    _check_size(width, rows, width * rows, data)
    if start < 14 + size:
        raise ValueError("broken BMP header")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        if bits == 8:
            index = raw[:, :width]
        else:
            bit = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            index = (bit * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, :width]
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size)
        palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        out = palette[index]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image; a grey one as it is."""
    return image if image.ndim == 2 else image[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target cell, parts of samples included, by an integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def cuts(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(k + 1) * (n / k)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = cuts(h, height), cuts(w, width)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    cells = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return cells * (height * width / (h * w))


def dhash(image: np.ndarray) -> str:
    """64 bits as hex: is a cell of the 8 rows by 9 columns reduction darker than its right neighbour?"""
    small = np.rint(area_resize(image, 8, 9) * 16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = TILE) -> bytes:
    """An NPY file of the side by side reduction, 8-bit, channels kept."""
    planes = [image] if image.ndim == 2 else [image[:, :, c] for c in range(image.shape[2])]
    scale = 257.0 if image.dtype == np.uint16 else 1.0
    small = [np.clip(np.rint(area_resize(p, side, side) / scale), 0, 255).astype(np.uint8) for p in planes]
    return npy(small[0] if image.ndim == 2 else np.stack(small, axis=2))


def media_features(df: DataFrame, media: str, side: int = TILE) -> DataFrame:
    """``_row`` (the other columns), height, width, dhash, tile (NPY bytes) and error for a binary column of images."""
    rest = [c for c in df.columns if c != media]
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row") if rest else F.lit(0).alias("_row"), F.col(f"`{media}`").alias("_media"))
    schema = given.select("_row").schema.add("height", "integer").add("width", "integer").add("dhash", "string").add("tile", "binary").add("error", "string")

    def run(batches):
        for b in batches:
            out = []
            for data in b.column(1):
                try:
                    image = decode(data.as_buffer().to_pybytes() if data.is_valid else b"")
                    out.append((*image.shape[:2], dhash(grey(image)), tile_of(image, side), None))
                except (ValueError, struct.error, IndexError, ArithmeticError) as e:
                    out.append((None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["_row", "height", "width", "dhash", "tile", "error"])

    bounded_batches(df.sparkSession)
    return given.mapInArrow(run, schema)


def text_payload(text: bytes, unit: int = WIDTH) -> bytes:
    """The bytes and zeros after them up to a positive multiple of the unit."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


TEXT_MEDIA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, tile_sha256 string"
)


def text_media(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Store each text as a PGM image, read the stored bytes back and take features of what was read.

    ``feature`` is the difference hash, ``tile_sha256`` that of the NPY tile.
    """

    def run(batches):
        names = [x.split()[0] for x in TEXT_MEDIA.split(", ")]
        for b in batches:
            out = []
            for value in b.column(1):
                raw = value.as_py().encode() if value.is_valid else b""
                media = encode_pgm(text_payload(raw))
                image = decode(media)
                payload = image.tobytes()
                sha = [hashlib.sha256(x).hexdigest() for x in (payload, media, tile_of(image))]
                out.append((len(raw), len(payload), sha[0], zlib.crc32(payload[-WIDTH:]), len(media), sha[1], dhash(image), sha[2]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, TEXT_MEDIA)
