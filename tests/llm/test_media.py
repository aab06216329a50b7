import struct

import numpy as np
import pytest
from parchmill.llm import media


def bmp(image, bits=24):
    h, w = image.shape[:2]
    stride = (w * bits + 31) // 32 * 4
    palette = b"".join(bytes([i, i, i, 0]) for i in range(1 << bits)) if bits <= 8 else b""
    rows = b""
    for r in image[::-1]:
        raw = r[:, ::-1].tobytes() if bits == 24 else (r.tobytes() if bits == 8 else np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes())
        rows += raw.ljust(stride, b"\0")
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(rows), 0, 0, start, 40, w, h, 1, bits, 0, len(rows), 0, 0, 0, 0) + palette + rows


def test_round_trips():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (7, 13), dtype=np.uint8)
    colour = rng.integers(0, 256, (5, 9, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P6 # note\n9 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n13 7\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (media.decode(b"P3\n9 5\n255\n" + b"\n".join(b"%d" % x for x in colour.ravel())) == colour).all()
    bits = grey & 1
    assert (media.decode(b"P4\n13 7\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    assert (media.decode(b"P1\n13 7\n" + b"\n".join(b" ".join(b"%d" % x for x in r) for r in bits)) == (1 - bits) * 255).all()
    wide = rng.integers(0, 65536, (3, 4), dtype=np.uint16)
    assert (media.decode(b"P5\n4 3\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    assert (media.decode(bmp(colour)) == colour).all()
    assert (media.decode(bmp(grey, 8)) == grey).all()
    assert (media.decode(bmp(grey & 15, 4)) == (grey & 15)).all()
    assert (media.decode(bmp(bits, 1)) == bits).all()


def test_resize_is_the_mean_of_areas():
    image = np.arange(12 * 18, dtype=np.uint8).reshape(12, 18)
    want = image.reshape(4, 3, 6, 3).mean(axis=(1, 3))
    assert np.allclose(media.resize(image, 4, 6), want)
    assert np.allclose(media.resize(image, 5, 7).mean(), image.mean())


@pytest.mark.parametrize("text", [None, "", "a", "é" * 32, "x" * 65, "long " * 5000])
def test_text_media(spark, text):
    import hashlib
    import zlib

    row = media.text_media(spark.createDataFrame([(1, text, "x"), (2, text, "y")], "doc_id long, text string, feature string")).collect()
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert row[0][1:] == row[1][1:]
    assert row[0].n_bytes == len(raw) and row[0].payload_bytes == len(payload)
    assert row[0].payload_sha256 == hashlib.sha256(payload).hexdigest() and row[0].tail_crc32 == zlib.crc32(payload[-64:])
    assert row[0].media_sha256 == hashlib.sha256(media.text_image(raw)).hexdigest()


def test_tiles_of_broken_media(spark):
    rows = [(1, b"P5\n2 2\n255\nabcd"), (2, b"nonsense"), (3, None), (4, b"P5\n9 9\n255\nab"), (5, b"")]
    out = {r.id: r for r in media.media_tiles(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert out[1].width == 2 and np.load(__import__("io").BytesIO(bytes(out[1].tile))).shape == (32, 32)
    assert all(out[i].tile is None and out[i].error for i in (2, 3, 4, 5))


def test_no_header_ends_the_job(spark):
    nines = b"9" * 30
    broken = [b"P5 99999999999 99999999999 255\n", b"P5 " + nines + b" " + nines + b" 255\n", b"P4 " + nines + b" 1\n", b"P1 4294967296 4294967296\n", b"P6 3037000500 3037000500 255\n", b"P2\n1 1\n255\n" + b"1" * 23, b"P2\n1 1\n255\n-3", b"P3\n1 1\n255\n1 x 2", b"P2 1 1 " + b"9" * 5000, b"P5 2 2 65535\nabcd", b"P1\n2 2\n1"]
    broken += [b"BM" + struct.pack("<IHHIIiiHHIIiiII", 60, 0, 0, 54, 40, 2**31 - 1, h, 1, b, 0, 4, 0, 0, u, 0) for h in (2**31 - 1, -(2**31)) for b in (1, 8, 32) for u in (0, 2**32 - 1)] + [b"BM", b"P", b"P5", b"P5 2", b"P5 #"]
    out = media.media_tiles(spark.createDataFrame(list(enumerate(broken)), "id long, media binary"), "id", "media").collect()
    assert len(out) == len(broken) and all(r.tile is None and r.error for r in out)
    rng = np.random.default_rng(2)
    for _ in range(3000):  # any bytes after a magic give an image or an error that is caught
        data = bytes(rng.choice([b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"BM"])) + rng.choice(np.frombuffer(b"0123456789 \n#-\xff\x00x", np.uint8), rng.integers(0, 40)).tobytes()
        try:
            media.decode(data)
        except (ValueError, IndexError, OverflowError, struct.error):
            pass


def test_scaled_samples_and_masks():
    assert media.decode(b"P5\n2 1\n15\n\x00\x0f").tolist() == [[0, 255]]
    assert media.decode(b"P2\n3 1\n4\n0 2 4").tolist() == [[0, 128, 255]]
    assert media.decode(b"P2\n2 1\n1000\n0 1000").tolist() == [[0, 65535]]
    with pytest.raises(ValueError):
        media.decode(b"P2\n1 1\n4\n9")
    rng = np.random.default_rng(1)
    colour = rng.integers(0, 256, (3, 2, 3), dtype=np.uint8)
    for order, masks in (("RGBA", (0xFF, 0xFF00, 0xFF0000)), ("BGRA", (0xFF0000, 0xFF00, 0xFF))):
        four = np.dstack([colour if order == "RGBA" else colour[:, :, ::-1], np.full((3, 2), 7, np.uint8)])
        raw = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 66 + 24, 0, 0, 66, 40, 2, -3, 1, 32, 3, 24, 0, 0, 0, 0) + struct.pack("<III", *masks) + four.tobytes()
        assert (media.decode(raw) == colour).all()
    with pytest.raises(ValueError):
        media.decode(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 60, 0, 0, 54, 40, 1, 1, 1, 24, 3, 4, 0, 0, 0, 0) + b"\0" * 4)


def test_empty_tables(spark):
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert media.media_tiles(spark.createDataFrame([], "id long, media binary"), "id", "media").count() == 0
