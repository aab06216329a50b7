"""TIFF frames against an independent writer, reduction of pages, rows of errors."""

import struct

import numpy as np
import pytest

from parchmill.sources import images


def packbits(data):
    out = b""
    while data:
        run = next((i for i in range(1, min(128, len(data))) if data[i] != data[0]), min(128, len(data)))
        if run > 1:
            out, data = out + bytes([257 - run, data[0]]), data[run:]
        else:
            n = min(len(data), 5)
            out, data = out + bytes([n - 1]) + data[:n], data[n:]
    return out


def lzw(data):
    """Codes of 9 to 12 bits; the table is emptied when it is full."""
    bits, table, word = "", {bytes([i]): i for i in range(256)}, b""
    size = 258

    def width():
        return 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12  # the reader is one entry behind

    bits += format(256, "09b")
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        bits += format(table[word], f"0{width()}b")
        table[word + c] = size
        size += 1
        word = c
        if size == 4094:
            bits += format(table[word], f"0{width()}b")
            size += 1
            bits += format(256, f"0{width()}b")
            table, size, word = {bytes([i]): i for i in range(256)}, 258, b""
    if word:
        bits += format(table[word], f"0{width()}b")
        size += 1
    bits += format(257, f"0{width()}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(frames, order="<"):
    """frames: (pixels height x width x samples as stored, bits, photometric, compression, rows of a strip, predictor)."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for x, bits, photometric, packing, rows, predictor in frames:
        strips = []
        if predictor == 2:
            x = np.diff(x, axis=1, prepend=np.zeros_like(x[:, :1]))
        for i in range(0, len(x), rows):
            part = x[i : i + rows]
            raw = np.packbits(part[:, :, 0], axis=1).tobytes() if bits == 1 else part.astype(order + "u2").tobytes() if bits == 16 else part.astype(np.uint8).tobytes()
            strips.append(lzw(raw) if packing == 5 else packbits(raw) if packing == 32773 else raw)
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        out += b"\0" * (len(out) % 2)

        def far(values, kind="I"):
            nonlocal out
            if len(values) == 1:
                return struct.pack(order + kind, values[0]).ljust(4, b"\0")
            at = len(out)
            out += struct.pack(f"{order}{len(values)}{kind}", *values)
            return struct.pack(order + "I", at)

        n = x.shape[2]
        entries = [(256, 4, 1, far([x.shape[1]])), (257, 4, 1, far([len(x)])), (258, 3, n, far([bits] * n, "H") if n != 2 else b""), (259, 3, 1, far([packing], "H")), (262, 3, 1, far([photometric], "H")), (273, 4, len(places), far(places)), (277, 3, 1, far([n], "H")), (278, 4, 1, far([rows])), (279, 4, len(strips), far([len(s) for s in strips])), (317, 3, 1, far([predictor], "H"))]
        at = len(out)
        out = out[:link] + struct.pack(order + "I", at) + out[link + 4 :]
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, c) + v for t, k, c, v in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_frames(order):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (37, 23, 1), dtype=np.uint8)
    flat = np.repeat(rng.integers(0, 256, (9, 1, 3), dtype=np.uint8), 300, axis=1)
    wide, bits, large = rng.integers(0, 65536, (5, 7, 1)).astype(np.uint16), rng.integers(0, 2, (6, 13, 1), dtype=np.uint8), rng.integers(0, 9, (120, 160, 3), dtype=np.uint8)
    four = rng.integers(0, 256, (4, 5, 4), dtype=np.uint8)
    frames = [(grey, 8, 1, 1, 37, 1), (grey, 8, 0, 32773, 10, 1), (flat, 8, 2, 5, 4, 1), (flat, 8, 2, 32773, 9, 2), (wide, 16, 1, 5, 2, 1), (bits, 1, 0, 32773, 6, 1), (bits, 1, 1, 1, 2, 1), (large, 8, 2, 5, 50, 2), (large, 8, 2, 5, 120, 1), (four, 8, 2, 1, 4, 1)]
    want = [images.netpbm(grey), images.netpbm(255 - grey), images.netpbm(flat), images.netpbm(flat), images.netpbm(wide, 65535), images.netpbm((1 - bits) * 255), images.netpbm(bits * 255), images.netpbm(large), images.netpbm(large), images.netpbm(four[:, :, :3])]
    assert images.pages(tiff(frames, order)) == want


def test_broken_files_are_rows(spark):
    good = tiff([(np.zeros((4, 4, 1), np.uint8), 8, 1, 1, 4, 1), (np.full((40, 20, 3), 9, np.uint8), 8, 2, 5, 7, 1)])
    rng = np.random.default_rng(5)
    broken = [None, b"", b"II*\0", b"MM\0*" + b"\xff" * 4, b"II*\0" + struct.pack("<I", 8) + b"\0\0" + b"\0" * 4, good[:-40], b"PDF"]
    for _ in range(200):  # any byte changed gives pages or an error row
        x = bytearray(good)
        x[rng.integers(0, len(x))] = rng.integers(0, 256)
        broken.append(bytes(x))
    table = spark.createDataFrame([(0, good), *((i, b) for i, b in enumerate(broken, 1))], "id long, content binary")
    out = images.page_images(table, most_side=10).collect()
    assert {r.id for r in out} == set(range(len(broken) + 1)) and all(any(r.id == i and r.error for r in out) for i in range(1, 8))
    first = {r.page: r for r in out if r.id == 0}
    assert bytes(first[2].image) == images.netpbm(np.full((10, 5, 3), 9, np.uint8)) and first[1].error is None


def test_reduction_is_the_mean_of_areas():
    x = np.arange(12 * 18 * 3).reshape(12, 18, 3) % 251
    small = images.reduced(images.netpbm(x), 6)
    assert small.startswith(b"P6\n6 4\n255\n")
    assert (np.frombuffer(small, np.uint8, offset=11).reshape(4, 6, 3) == np.rint(x.reshape(4, 3, 6, 3, 3).mean(axis=(1, 3)))).all()
    assert images.reduced(images.netpbm(x), 18) == images.netpbm(x)
    assert images.reduced(images.netpbm(np.full((1, 100, 1), 7)), 10) == images.netpbm(np.full((1, 10, 1), 7))
