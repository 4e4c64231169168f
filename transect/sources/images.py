"""What the first bytes of an image file say: size, orientation, camera, focal length, altitude. No pixel is decoded.

JPEG: segments up to the frame header, with the EXIF segment among them. PNG: its header, and its EXIF chunk if that comes before the pixels.
EXIF is a TIFF directory in either byte order, with one of its own for the lens and one for the position.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transect.session import prepare

HEAD_BYTES = 1 << 18
FACTS = "width int, height int, orientation int, make string, model string, focal_mm double, altitude_m double"
_NAMES = [part.split()[0] for part in FACTS.split(", ")]
# Fixed values of the formats: frame headers of JPEG, sizes of TIFF's types, and tags.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_NUMBERS = {1: "B", 3: "H", 4: "I", 9: "i"}
_MAKE, _MODEL, _ORIENTATION, _LENS, _POSITION, _FOCAL, _BELOW, _ALTITUDE = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825, 0x920A, 5, 6


def _directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """Tags of a directory with their first value; what lies outside of the bytes is left out."""
    out: dict[int, object] = {}
    if at < 8 or at + 2 > len(tiff):
        return out
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        length = _SIZES.get(kind, 0) * count
        place = entry + 8 if length <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        if not length or place + length > len(tiff):
            continue
        if kind in (2, 7):
            out[tag] = tiff[place : place + length].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            above, below = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, place)
            out[tag] = above / below if below else None
        else:
            out[tag] = struct.unpack_from(order + _NUMBERS[kind], tiff, place)[0]
    return out


def exif(tiff: bytes) -> dict[str, object]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return {}
    top = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    lens, position = (_directory(tiff, p, order) if isinstance(p := top.get(tag), int) else {} for tag in (_LENS, _POSITION))
    altitude = position.get(_ALTITUDE)
    if altitude is not None and position.get(_BELOW) == 1:  # below sea level
        altitude = -altitude
    orientation = top.get(_ORIENTATION)
    return {"orientation": orientation if isinstance(orientation, int) and 1 <= orientation <= 8 else None, "make": top.get(_MAKE), "model": top.get(_MODEL), "focal_mm": lens.get(_FOCAL), "altitude_m": altitude}


def _jpeg(head: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        kind = head[at + 1]
        if kind == 0xFF:  # filling
            at += 1
            continue
        if kind == 1 or 0xD0 <= kind <= 0xD8:  # without a body
            at += 2
            continue
        length = struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + length]
        if kind in _FRAMES and len(body) >= 5:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            break
        if kind == 0xDA or length < 2:  # pixels, or no segment
            break
        if kind == 0xE1 and body[:6] == b"Exif\0\0" and "orientation" not in out:
            out |= exif(body[6:])
        at += 2 + length
    return out


def _png(head: bytes) -> dict[str, object]:
    out: dict[str, object] = {}
    at = 8
    while at + 8 <= len(head):
        length, kind = struct.unpack_from(">I4s", head, at)
        body = head[at + 8 : at + 8 + length]
        if kind == b"IHDR" and len(body) >= 8:
            out["width"], out["height"] = struct.unpack_from(">II", body)
        elif kind == b"eXIf":
            out |= exif(body)
        elif kind in (b"IDAT", b"IEND"):
            break
        at += 12 + length
    return out


def facts(head: bytes | None) -> tuple:
    """(width, height, orientation, make, model, focal_mm, altitude_m); null where the bytes don't say."""
    head = bytes(head or b"")
    found = _jpeg(head) if head[:2] == b"\xff\xd8" else _png(head) if head[:8] == b"\x89PNG\r\n\x1a\n" else {}
    return tuple(found.get(n) for n in _NAMES)


def with_facts(files: DataFrame, content: str = "content", head_bytes: int = HEAD_BYTES) -> DataFrame:
    """files with what their first bytes say, in columns; other formats, broken and null ones get nulls. ``content``: as
    ``spark.read.format("binaryFile")`` gives it; Arrow batches of the first bytes alone go to Python."""
    prepare(files.sparkSession)

    @F.pandas_udf(FACTS)
    def read(heads: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([facts(h) for h in heads], columns=_NAMES)
        return rows.astype({"width": "Int32", "height": "Int32", "orientation": "Int32", "make": object, "model": object, "focal_mm": float, "altitude_m": float})

    return files.withColumn("_facts", read(F.substring(content, 1, head_bytes))).select(*files.columns, *[F.col(f"_facts.{n}").alias(n) for n in _NAMES])
