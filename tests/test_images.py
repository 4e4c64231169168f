import struct
import zlib

import pytest

from transect.sources import images


def tiff(order, orientation=6, make=b"DJI", model=b"Zenmuse P1", focal=(350, 10), altitude=(12345, 100), below=0):
    """A TIFF directory with one for the lens and one for the position, written entry by entry."""
    o = "<" if order == "II" else ">"
    data = b""
    base = 8 + (2 + 5 * 12 + 4) + (2 + 12 + 4) + (2 + 24 + 4)

    def later(raw):
        nonlocal data
        at = base + len(data)
        data += raw
        return struct.pack(o + "I", at)

    def entry(tag, kind, count, value):
        return struct.pack(o + "HHI", tag, kind, count) + value.ljust(4, b"\0")

    text = lambda t, s: entry(t, 2, len(s) + 1, s + b"\0" if len(s) < 4 else later(s + b"\0"))
    top = [text(0x10F, make), text(0x110, model), entry(0x112, 3, 1, struct.pack(o + "H", orientation)), entry(0x8769, 4, 1, struct.pack(o + "I", 74)), entry(0x8825, 4, 1, struct.pack(o + "I", 92))]
    lens = [entry(0x920A, 5, 1, later(struct.pack(o + "II", *focal)))]
    position = [entry(5, 1, 1, bytes([below])), entry(6, 5, 1, later(struct.pack(o + "II", *altitude)))]
    out = order.encode() + struct.pack(o + "HI", 42, 8)
    for entries in (top, lens, position):
        out += struct.pack(o + "H", len(entries)) + b"".join(entries) + struct.pack(o + "I", 0)
    return out + data


def jpeg(width, height, exif=None, before=b"", frame=0xC0):
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + before
    if exif is not None:
        out += segment(0xE1, b"Exif\0\0" + exif)
    return out + segment(0xDB, bytes(65)) + b"\xff\xff" + segment(frame, struct.pack(">BHHB", 8, height, width, 3) + bytes(9)) + segment(0xDA, bytes(10)) + bytes(50) + b"\xff\xd9"


def png(width, height, exif=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", bytes(20)) + chunk(b"IEND", b"")


ALL = (6, "DJI", "Zenmuse P1", 35.0, 123.45)
NONE = (None,) * 5


@pytest.mark.parametrize("order", ["II", "MM"])
def test_formats(order):
    assert images.facts(jpeg(8192, 5460, tiff(order))) == (8192, 5460, *ALL)
    assert images.facts(png(640, 480, tiff(order))) == (640, 480, *ALL)
    assert images.facts(jpeg(3, 70, tiff(order, below=1, focal=(1, 0)), frame=0xC2)) == (3, 70, 6, "DJI", "Zenmuse P1", None, -123.45)
    assert images.facts(jpeg(3, 70, tiff(order, orientation=9)))[2] is None
    other = b"\xff\xe1" + struct.pack(">H", 12) + b"http://ns\0"
    assert images.facts(jpeg(10, 20, tiff(order), before=other)) == (10, 20, *ALL)


def test_files_without_or_with_broken_headers():
    assert images.facts(jpeg(10, 20)) == (10, 20, *NONE)
    assert images.facts(png(10, 20)) == (10, 20, *NONE)
    for head in (None, b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", b"BM1234", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe1\x00\x00" + bytes(20)):
        assert images.facts(head) == (None,) * 7
    whole = jpeg(10, 20, tiff("II"))
    for cut in range(len(whole)):
        assert len(images.facts(whole[:cut])) == 7
    body = bytearray(tiff("MM"))
    for at in range(len(body)):
        body[at] ^= 0xFF
        images.facts(jpeg(1, 1, bytes(body)))
        body[at] ^= 0xFF


def test_binary_files(spark, tmp_path):
    want = {}
    for k in range(12):
        raw = jpeg(100 + k, 50 + k, tiff("II" if k % 2 else "MM", orientation=k % 8 + 1)) if k % 3 else png(100 + k, 50 + k)
        (tmp_path / f"{k}.img").write_bytes(raw)
        want[f"{k}.img"] = (100 + k, 50 + k, *((k % 8 + 1, *ALL[1:]) if k % 3 else NONE))
    (tmp_path / "note.img").write_text("not an image")
    want["note.img"] = (None,) * 7
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in images.with_facts(files.select("path", "content")).drop("content").collect()}
    assert found == want
    assert images.with_facts(files.select("path", "content").limit(0)).count() == 0
