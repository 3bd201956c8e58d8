"""Media columns: Netpbm and BMP images held as binary columns, resized by integral images, tiled as NPY.

`write_pnm`/`write_bmp` store 8-bit samples losslessly, `read_image` decodes either form to a numpy array,
`resize` averages areas through an integral image (summed-area table), `tile` writes an NPY file and
`difference_hash` compares neighbours of an 8 x 9 reduction. `store` turns texts into stored images and
`inspect` reads the stored bytes back and derives tiles and hashes from what it read.

Null texts are stored as empty ones; an empty payload is one row of 64 zero samples. A stored image that
is null or can't be decoded has null width, tile, hash and payload. Rows are kept one for one; columns
other than those named are not read.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_texts, table

#: Samples in a stored row; texts are padded with zeros to a positive multiple of it.
ROW = 64
#: Side of the square tile that is written as NPY.
TILE = 16
#: Samples that are summed at once as doubles.
STRIP = 1 << 18
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")


def write_pnm(samples: np.ndarray) -> bytes:
    """P5 of (height, width) or P6 of (height, width, 3) unsigned bytes."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def write_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP, 8-bit grey palette or 24-bit colour, rows from bottom to top."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    rows = samples if grey else samples[:, :, ::-1].reshape(h, w * 3)
    pad = -rows.shape[1] % 4
    body = np.pad(rows[::-1].astype(np.uint8), ((0, 0), (0, pad))).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3] = 0
    at = 54 + palette.size
    head = b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, len(palette), 0) + palette.tobytes() + body


def read_image(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) unsigned bytes of a Netpbm (P1 to P6, at most 255) or BMP (8 or 24 bits) file."""
    return _read_bmp(data) if data[:2] == b"BM" else _read_pnm(data)


def _read_pnm(data: bytes) -> np.ndarray:
    # A bitmap's header has no largest value; the pattern must not take its first sample for one.
    found = re.match(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)()\s", data) or _HEADER.match(data)
    if not found:
        raise ValueError("not a Netpbm file")
    kind, w, h, top = int(found[1]), int(found[2]), int(found[3]), int(found[4] or 1)
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples are read")
    body, shape = data[found.end() :], (h, w, 3) if kind in (3, 6) else (h, w)
    n = int(np.prod(shape))
    if kind == 4:
        return (1 - np.unpackbits(np.frombuffer(body, np.uint8, h * (-(-w // 8))).reshape(h, -1), axis=1)[:, :w]) * np.uint8(255)
    if kind < 4:
        body = re.sub(rb"#[^\n]*", b"", body)
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == 1 else body.split())[:n]], np.uint8)
        return (1 - values.reshape(shape)) * np.uint8(255) if kind == 1 else values.reshape(shape)
    return np.frombuffer(body, np.uint8, n).reshape(shape)


def _read_bmp(data: bytes) -> np.ndarray:
    at, size, w, h, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24) or w <= 0 or not h:
        raise ValueError("only uncompressed 8 and 24 bit BMP files are read")
    wide = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * wide, at).reshape(abs(h), wide)[:: -1 if h > 0 else 1, : w * bits // 8]
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    colour = palette[np.minimum(rows, used - 1)]
    return colour[:, :, 0] if (palette == palette[:, :1]).all() else colour


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image @ np.array([299, 587, 114]) / 1000)


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the m + 1 edges of m equal parts of n samples lie: whole samples before each, and the part of the next one."""
    x = np.arange(m + 1) * n / m
    lo = np.minimum(x.astype(np.int64), n - 1)
    return lo, x - lo


def integral_rows(image: np.ndarray, height: int) -> np.ndarray:
    """The integral image, in grey, at the edges of `height` equal parts of its rows.

    Up to STRIP samples the whole of it is made and interpolated. Of a larger image only the rows at the edges are kept, and
    those below each are summed STRIP samples at a time, so an image of any size takes little more memory than its samples.
    """
    h, w = image.shape[:2]
    y, part = _edges(h, height)
    if h * w <= STRIP:
        whole = np.zeros((h + 1, w + 1))
        np.cumsum(np.cumsum(grey(image), axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])
        low = whole[y]
        return low + part[:, None] * (whole[y + 1] - low)
    step = max(1, STRIP // w)
    rows, total, at = np.zeros((height + 1, w + 1)), np.zeros(w + 1), 0
    for k, (lo, more) in enumerate(zip(y.tolist(), part.tolist(), strict=True)):
        while at < lo:
            upto = min(lo, at + step)
            total[1:] += np.cumsum(grey(image[at:upto]).sum(axis=0, dtype=np.float64))
            at = upto
        rows[k] = total
        if more:
            rows[k, 1:] += more * np.cumsum(grey(image[lo : lo + 1])[0], dtype=np.float64)
    return rows


def area_averages(rows: np.ndarray, height: int, width: int) -> np.ndarray:
    """Averages of the parts between integral rows of an image of `height` rows, in `width` columns."""
    w = rows.shape[1] - 1
    x, part = _edges(w, width)
    at = rows[:, x] * (1 - part) + rows[:, x + 1] * part
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums / (height * w / ((len(rows) - 1) * width))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of an image, in grey, as doubles."""
    return area_averages(integral_rows(image, height), image.shape[0], width)


def _signs(small: np.ndarray) -> str:
    small = np.round(small, 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def _npy(small: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(small), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: of 8 rows of 9 area averages, whether each is below its right neighbour."""
    return _signs(resize(image, 8, 9))


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    return _npy(resize(image, side, side))


def tile_and_hash(image: np.ndarray, side: int = TILE) -> tuple[bytes, str]:
    """Both from one reduction of the rows, where the 8 rows of the hash are whole ones of the tile."""
    if side % 8:
        return tile(image, side), difference_hash(image)
    h, rows = image.shape[0], integral_rows(image, side)
    return _npy(area_averages(rows, h, side)), _signs(area_averages(rows[:: side // 8], h, 9))


def store(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), form: str = "pnm") -> DataFrame:
    """Columns `keep`, n_bytes of the text and `media`: its zero-padded bytes as an image 64 samples wide."""
    write = {"pnm": write_pnm, "bmp": write_bmp}[form]

    def score():
        def work(texts: list[str]) -> list[pa.Array]:
            raw = [t.encode() for t in texts]
            padded = [b.ljust(max(ROW, -(-len(b) // ROW) * ROW), b"\0") for b in raw]
            return [pa.array([len(b) for b in raw], pa.int64()), pa.array([write(np.frombuffer(b, np.uint8).reshape(-1, ROW)) for b in padded], pa.binary())]

        return work

    return map_texts(docs, list(keep), "n_bytes long, media binary", score)


_READ = (
    ("width", T.IntegerType(), pa.int32()),
    ("height", T.IntegerType(), pa.int32()),
    ("payload", T.BinaryType(), pa.binary()),
    ("tail_crc32", T.LongType(), pa.int64()),
    ("tile", T.BinaryType(), pa.binary()),
    ("dhash", T.StringType(), pa.string()),
)


def _inspected(data: bytes | None, side: int) -> tuple:
    if data is None:
        return (None,) * 6
    try:
        image = read_image(data)
    except (ValueError, struct.error):
        return (None,) * 6
    payload = image.tobytes()
    return image.shape[1], image.shape[0], payload, zlib.crc32(payload[-ROW:]), *tile_and_hash(image, side)


def inspect(stored: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "n_bytes", "media"), side: int = TILE) -> DataFrame:
    """Columns `keep` and, read from `media`: width, height, payload (all samples), crc32 of its last 64 bytes, NPY tile and difference hash."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("media")
            size = max(1, b.num_rows * (4 << 20) // max(1, b.column(at).nbytes))
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                rows = [_inspected(m.as_py(), side) for m in part.column(at)]
                made = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(_READ)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *(n for n, _, _ in _READ)])

    bound_batches(stored)
    return stored.select(*dict.fromkeys([*keep, "media"])).mapInArrow(run, T.StructType([stored.schema[c] for c in keep] + [T.StructField(n, kind) for n, kind, _ in _READ]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(store(table(spark, sf_dir, "documents"))).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"),
        "width",
        "height",
    )
