"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form and difference hashes.

Decoders: Netpbm P1 to P6 (comments, 8 and 16 bit, samples scaled to the full range) and uncompressed BMP of 1, 4, 8, 24
and 32 bits, the last also with bit fields. Resizing
averages areas through an integral image, with fractions of pixels at the edges. Everything happens row by row in
Arrow batches, so memory is one batch and one image's integral.

Defined cases: null or broken media give null columns (``error`` says why); ``text_media`` takes a null text as
empty and pads it to one row of 64 zero samples; repeated rows and equal texts get equal values; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.common import as_bytes, bounded_batches, documents

WIDTH = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5) of a two-dimensional array of bytes."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic, comments left out, and where the raster begins."""
    at, out = 2, []
    while len(out) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """Height x width (P1, P2, P4, P5) or height x width x 3; bitmaps give 0 for black and 255 for white."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    bitmap, planes = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    row = (width + 7) // 8
    least = row * height if kind == 4 else width * height * planes * (2 if kind > 4 and top > 255 else 1)  # bytes; a sample as text takes one at least
    if not width or not height or not 0 < top < 65536 or least > len(data):
        raise ValueError("broken Netpbm header")
    if kind == 4:
        pixels = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
    elif kind == 1:
        bits = [c - 48 for c in b"".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n")) if c in b"01"]
        pixels = np.array(bits[: width * height], dtype=np.uint8)
    elif kind in (2, 3):
        samples = list(map(int, b" ".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n")).split()[: width * height * planes]))
        if not all(0 <= x <= top for x in samples):
            raise ValueError("a sample above the maximum")
        pixels = np.array(samples, dtype=np.int64)
    else:
        pixels = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height * planes, at)
    pixels = pixels.reshape((height, width, 3) if planes == 3 else (height, width))
    if bitmap:
        return ((1 - pixels) * 255).astype(np.uint8)
    full = 255 if top < 256 else 65535
    if (pixels > top).any():
        raise ValueError("a sample above the maximum")
    return (pixels if top == full else np.rint(pixels * (full / top))).astype(np.uint8 if full == 255 else np.uint16)


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The field of a mask, scaled to 8 bits."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    if top & (top + 1):
        raise ValueError("broken BMP mask")
    return np.rint(((pixels & np.uint32(mask)) >> np.uint32(low)) * (255 / top)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Height x width (grey palettes) or height x width x 3, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packing == 3 and bits != 32 or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if packing == 3:  # bit fields: a mask for each colour, behind the header of 40 bytes or inside a longer one
        masks = struct.unpack_from("<III", data, 54)
        pixels = np.ascontiguousarray(raw[:, : width * 4]).view("<u4")
        return np.stack([_masked(pixels, m) for m in masks], axis=2)
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = raw[:, :width]
    else:
        index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = (index @ (1 << np.arange(bits)[::-1]))[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
    out = palette[index]
    return np.ascontiguousarray(out[:, :, 0]) if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, by an integral image that is read between pixels by interpolation."""
    rows, cols = image.shape
    integral = np.zeros((rows + 1, cols + 1))
    np.cumsum(image, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    y, x = np.arange(height + 1) * (rows / height), np.arange(width + 1) * (cols / width)
    top, left = np.minimum(y.astype(int), rows - 1), np.minimum(x.astype(int), cols - 1)
    fy, fx = (y - top)[:, None], x - left
    across = integral[top] * (1 - fy) + integral[top + 1] * fy
    cells = across[:, left] * (1 - fx) + across[:, left + 1] * fx
    return np.diff(np.diff(cells, axis=0), axis=1) / ((rows / height) * (cols / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 cells darker than its right neighbour."""
    small = np.round(resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(image: np.ndarray, edge: int) -> bytes:
    """The image resized to edge x edge, as an NPY file."""
    held = io.BytesIO()
    np.lib.format.write_array(held, np.clip(np.rint(resize(image, edge, edge)), 0, 65535 if image.dtype == np.uint16 else 255).astype(image.dtype if image.dtype.kind == "u" else np.uint8), allow_pickle=False)
    return held.getvalue()


def media_tiles(df: DataFrame, id_column: str, media_column: str, edge: int = 32) -> DataFrame:
    """id, width, height, channels, NPY tile, difference hash and error of a binary column of Netpbm or BMP files."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def one(key, data) -> dict:
        if data is None:
            return {"id": key, "error": "null"}
        try:
            image = decode(data)
            flat = grey(image)
            return {"id": key, "width": image.shape[1], "height": image.shape[0], "channels": 1 if image.ndim == 2 else 3, "tile": tile(flat, edge), "dhash": difference_hash(flat)}
        except (ValueError, IndexError, OverflowError, struct.error) as e:
            return {"id": key, "error": str(e)[:200]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(k, d) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], schema=schema)

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).cast("binary").alias("media")).mapInArrow(run, "id long, width int, height int, channels int, tile binary, dhash string, error string")


def text_image(text: bytes) -> bytes:
    """A PGM file 64 samples wide that holds the text, with bytes 0 to the end of its last row (one row at least)."""
    rows = max(1, -(-len(text) // WIDTH))
    return encode_pgm(np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def text_media(docs: DataFrame, edge: int = 32) -> DataFrame:
    """Every text stored as a PGM file, read back by the decoder; feature is the stored image's difference hash."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(doc, text: bytes) -> tuple:
        stored = text_image(text)
        image = decode(stored)
        payload = image.tobytes()
        return doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(tile(image, edge)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(d, t) for d, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
