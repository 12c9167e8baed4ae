"""Sizes of pictures of six formats, pixels and regions of built ones."""

import struct
import zlib

import numpy as np
import pytest

from sieveline.plans import media_fixtures as made
from sieveline.sources import images


def picture(h, w, step, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, step), dtype=np.uint8)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\0\x07JFIF\0\xff\xff\xdb\0\x04ab\xff\xc4\0\x04\xff\xc0\xff\xc2\0\x0b\x08" + struct.pack(">HH", h, w) + b"\1\0\0\0"


def tiff(w, h, o="<"):
    head = (b"II*\0" if o == "<" else b"MM\0*") + struct.pack(o + "I", 10) + b"xx"
    return head + struct.pack(o + "H", 3) + struct.pack(o + "HHI", 256, 3, 1) + struct.pack(o + "HH", w, 0) + struct.pack(o + "HHII", 257, 4, 1, h) + struct.pack(o + "HHII", 258, 4, 1, 8)


def bmp(x, down=False):
    rows = x[:, :, ::-1] if down else x[::-1, :, ::-1]
    pad = bytes(-x.shape[1] * 3 % 4)
    body = b"".join(r.tobytes() + pad for r in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, x.shape[1], -x.shape[0] if down else x.shape[0], 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_sizes(spark):
    webp = lambda body: b"RIFF\0\0\0\0WEBP" + body + bytes(20)
    files = {
        "j": jpeg(640, 480), "p": made.png(picture(7, 9, 3)), "g": b"GIF89a" + struct.pack("<HH", 12, 34) + bytes(20), "b": bmp(picture(5, 6, 3)), "bd": bmp(picture(5, 6, 3), True), "tl": tiff(300, 200), "tb": tiff(301, 201, ">"),
        "wx": webp(b"VP8X" + bytes(8) + (999).to_bytes(3, "little") + (499).to_bytes(3, "little")), "wl": webp(b"VP8L" + bytes(4) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")), "wv": webp(b"VP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 320, 240)),
        "none": b"", "text": b"no picture", "cut": jpeg(1, 1)[:9], "early": b"\xff\xd8\xff\xda\0\0",
    }
    got = {r.uri: r for r in images.read_sizes(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "uri string, content binary")).collect()}
    assert {k: (r.format, r.width, r.height) for k, r in got.items() if r.decodable} == {
        "j": ("JPEG", 640, 480), "p": ("PNG", 9, 7), "g": ("GIF", 12, 34), "b": ("BMP", 6, 5), "bd": ("BMP", 6, 5), "tl": ("TIFF", 300, 200), "tb": ("TIFF", 301, 201), "wx": ("WEBP", 1000, 500), "wl": ("WEBP", 100, 50), "wv": ("WEBP", 320, 240),
    }
    assert all(r.error for r in got.values() if not r.decodable) and len(got) == len(files)


@pytest.mark.parametrize("step,colour,depth", [(1, 0, 8), (3, 2, 8), (4, 6, 8), (2, 4, 8), (6, 2, 16), (1, 3, 8)])
def test_pixels_come_back_from_every_predictor(step, colour, depth):
    x = picture(11, 13, step)
    got, d, c, _ = images.pixels(made.png(x, depth, colour))
    assert (got == x).all() and (d, c) == (depth, colour)
    again = images.pixels(images.png(x, depth, colour))[0]
    assert (again == x).all()


def test_a_crop_is_the_slice(spark):
    x = picture(20, 30, 3)
    files = spark.createDataFrame([("p", bytearray(made.png(x))), ("b", bytearray(bmp(x))), ("d", bytearray(bmp(x, True))), ("j", bytearray(jpeg(9, 9))), ("cut", bytearray(made.png(x)[:200]))], "uri string, content binary")
    boxes = [(0.0, 0.0, 1.0, 1.0), (0.1, 0.25, 0.5, 0.5), (0.99, 0.99, 0.01, 0.01), (0.5, 0.5, 0.6, 0.1)]
    asked = spark.createDataFrame([(u, *b) for u in ("p", "b", "d", "j", "cut") for b in boxes], "uri string, x double, y double, w double, h double")
    got = images.crop_regions(files, asked).collect()
    assert len(got) == 20
    for r in got:
        if r.uri in "jcut" or r.x == 0.5:
            assert r.png is None and r.error
            continue
        want = x[int(r.y * 20) : max(int(r.y * 20) + 1, int((r.y + r.h) * 20)), int(r.x * 30) : max(int(r.x * 30) + 1, int((r.x + r.w) * 30))]
        assert (images.pixels(bytes(r.png))[0] == want).all() and (r.height, r.width) == want.shape[:2]
        zlib.decompress(bytes(r.png)[41:-16])
