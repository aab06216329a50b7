"""Document files as page images: one row for each page; binary Netpbm files may hold several, one after the other.

PDF and compressed image formats need a decoder, which a caller gives as a callable (bytes to a list of page images).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parchmill.session import bounded_batches

#: Pixels that are not white below which a page is blank.
BLANK = 5
HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
PAGES = "id long, page int, image binary, blank boolean, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files, as Spark's own source reads them."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def netpbm_pages(content: bytes) -> list[bytes]:
    """The images of a binary grey or colour Netpbm file."""
    out, at = [], 0
    while at < len(content) and content[at:].strip():
        if not (m := HEADER.match(content, at)):
            raise ValueError("not a Netpbm image")
        width, height, top = (int(m[i]) for i in (2, 3, 4))
        end = m.end() + width * height * (3 if m[1] == b"6" else 1) * (2 if top > 255 else 1)
        if not 0 < top < 65536 or end > len(content):
            raise ValueError("broken Netpbm image")
        out.append(content[at:end])
        at = end
    return out


def is_blank(image: bytes, most: int = BLANK) -> bool:
    """Fewer than ``most`` pixels that are not white, in grey (ITU-R 601 weights)."""
    m = HEADER.match(image)
    top = int(m[4])
    x = np.frombuffer(image, ">u2" if top > 255 else np.uint8, offset=m.end())
    if m[1] == b"6":
        x = x.reshape(-1, 3) @ np.array([19595, 38470, 7471]) + 0x8000 >> 16
    return int((x * (255 / top) < 254.5).sum()) < most


#: Fixed values of the TIFF format: tags, sizes of its integer types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
INTEGERS = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, PACKBITS = 1, 5, 32773
#: Bytes of one decoded frame at most.
MOST_BYTES = 1 << 28


def _unpacked(data: bytes, size: int) -> bytes:
    """PackBits: a count n below 128 and n + 1 bytes as they are, or 256 - n + 1 times the next byte; 128 says nothing."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unlzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first; 256 empties the table, 257 ends."""
    out, table, last, held, have, width = bytearray(), [], b"", 0, 0, 9
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & (1 << have) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("broken LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last and len(table) < 4096:
            table.append(last + word[:1])
        last, width = word, 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def tiff_pages(content: bytes) -> list[bytes]:
    """The frames of a TIFF file as Netpbm images: strips of 1, 8 or 16 bits, grey or colour, plain, LZW or PackBits."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or content[2:4] not in (b"*\0", b"\0*"):
        raise ValueError("not a TIFF image")
    at, out, seen = struct.unpack_from(order + "I", content, 4)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", content, at)[0], {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", content, entry)
            if kind in INTEGERS and count <= len(content):
                size = count * struct.calcsize("=" + INTEGERS[kind])
                where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{INTEGERS[kind]}", content, where)
        out.append(_frame(content, order, tags))
        at = struct.unpack_from(order + "I", content, at + 2 + 12 * n)[0]
    if not out:
        raise ValueError("a TIFF file without frames")
    return out


def _frame(content: bytes, order: str, tags: dict[int, tuple]) -> bytes:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits, samples = one(WIDTH), one(HEIGHT), one(BITS, 1), one(SAMPLES, 1)
    packing, photometric, predictor = one(COMPRESSION, PLAIN), one(PHOTOMETRIC), one(PREDICTOR, 1)
    grey = photometric in (0, 1)
    if not width or not height or bits not in (1, 8, 16) or packing not in (PLAIN, LZW, PACKBITS) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("unsupported TIFF frame")
    if not (grey or photometric == 2 and samples >= 3 and bits > 1) or grey and bits == 1 and samples != 1 or predictor == 2 and bits == 1 or OFFSETS not in tags or len(tags.get(COUNTS, ())) != len(tags[OFFSETS]):
        raise ValueError("unsupported TIFF frame")
    stride, rows = (width * samples * bits + 7) // 8, min(one(ROWS, height) or height, height)
    if stride * height > MOST_BYTES or len(tags[OFFSETS]) < -(-height // rows):
        raise ValueError("broken TIFF frame")
    raw = b""
    for i, (start, size) in enumerate(zip(tags[OFFSETS], tags[COUNTS])):
        want = stride * max(0, min(rows, height - i * rows))
        strip = content[start : start + size]
        strip = (_unlzw(strip, want) if packing == LZW else _unpacked(strip, want) if packing == PACKBITS else strip)[:want]
        if len(strip) < want:
            raise ValueError("a TIFF strip is cut off")
        raw += strip
    if bits == 1:
        x = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, stride), axis=1)[:, :width, None] * np.uint8(255)
    else:
        x = np.frombuffer(raw, np.uint8 if bits == 8 else order + "u2").reshape(height, width, samples)
    if predictor == 2:  # each sample is the difference from the one to its left
        x = np.cumsum(x, axis=1, dtype=np.uint8 if bits == 8 else np.uint16)
    x = x[:, :, :1] if grey else x[:, :, :3]
    top = 255 if bits < 16 else 65535
    return netpbm(top - x if photometric == 0 else x, top)


def netpbm(image: np.ndarray, top: int = 255) -> bytes:
    """height x width x 1 or 3 samples as a binary Netpbm file."""
    height, width, planes = image.shape
    return b"P%d\n%d %d\n%d\n" % (5 if planes == 1 else 6, width, height, top) + image.astype(">u2" if top > 255 else np.uint8).tobytes()


def pages(content: bytes) -> list[bytes]:
    """The images of a TIFF or Netpbm file."""
    return tiff_pages(content) if content[:2] in (b"II", b"MM") else netpbm_pages(content)


def _halves(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(size + 1) * (n / size)
    low = np.minimum(edges.astype(int), n - 1)
    return low, edges - low


def reduced(image: bytes, side: int) -> bytes:
    """A Netpbm image with no side longer than ``side``, in its proportions, each new pixel the mean of the area it covers; a smaller one as it is."""
    m = HEADER.match(image)
    width, height, top = (int(m[i]) for i in (2, 3, 4))
    if max(width, height) <= side:
        return image
    x = np.frombuffer(image, ">u2" if top > 255 else np.uint8, offset=m.end()).reshape(height, width, -1).astype(np.float64)
    for axis, n in enumerate((height, width)):
        size = max(1, round(n * side / max(width, height)))
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis=axis)], axis=axis)
        low, part = _halves(n, size)
        part = part.reshape([-1 if i == axis else 1 for i in range(3)])
        x = np.diff(total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part, axis=axis) * (size / n)
    return netpbm(np.rint(x), top)


def page_images(docs: DataFrame, decode: Callable[[bytes], list[bytes]] = pages, most_side: int | None = None) -> DataFrame:
    """(id, page, image, blank, error) of (id, content); a blank page has a null image, what cannot be decoded is one row with its error.

    Null and empty content is an error too, so each document has a row. ``most_side`` reduces larger Netpbm pages.
    """
    bounded_batches(docs.sparkSession)

    def rows(key, content: bytes | None) -> Iterator[tuple]:
        try:
            found = decode(content) if content else []
            if not found:
                raise ValueError("no content" if not content else "no pages")
            for i, image in enumerate(found, 1):
                known = HEADER.match(image) is not None
                empty = known and is_blank(image)
                yield key, i, None if empty else reduced(image, most_side) if known and most_side else image, empty, None
        except Exception as e:  # noqa: BLE001  one file's failure stays with the file
            yield key, None, None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.string()]
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):  # a batch for each file: pages are large
                out = list(rows(key, content))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in PAGES.split(", ")])

    return docs.select("id", "content").mapInArrow(run, PAGES)
