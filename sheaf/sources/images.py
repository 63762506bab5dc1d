"""Pages of images from their headers alone: size, frames and rotation, without a codec.

PNG (animations too), TIFF, JPEG and WebP. Pixels aren't decoded, so damage behind the
headers isn't found here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

PAGE = "batch_id string, source_id string, page_index int, width_pt double, height_pt double, error string"
#: Tags of width, height and orientation; orientations that lie on their side; JPEG frame markers.
_WIDTH, _HEIGHT, _ORIENTATION, _TURNED = 256, 257, 274, (5, 6, 7, 8)
_FRAME_MARKERS = [*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)]

Size = tuple[int, int]


def _shown(width: int, height: int, orientation: int) -> Size:
    if width <= 0 or height <= 0:
        raise ValueError("an image without a size")
    return (height, width) if orientation in _TURNED else (width, height)


def _directories(data: bytes) -> Iterator[dict[int, int]]:
    """Tag values (16 or 32 bits, one each) of every directory of a TIFF structure; each is visited once."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF of 32-bit offsets")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        found = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if count == 1 and kind in (3, 4):
                found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
        yield found
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _orientation(exif: bytes) -> int:
    """The first directory's orientation, 1 where metadata has none or is damaged."""
    try:
        return next(_directories(exif.removeprefix(b"Exif\0\0")), {}).get(_ORIENTATION, 1)
    except (KeyError, ValueError, struct.error):
        return 1


def _png(data: bytes) -> list[Size]:
    at, size, frames, turned, alone = 8, None, 1, 1, True
    while at + 8 <= len(data):
        length, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if name == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif name == b"acTL":
            frames, alone = struct.unpack_from(">I", body)[0], False
            first_is_shown = False
        elif name == b"fcTL" and not alone:
            first_is_shown = True
        elif name == b"IDAT" and not alone:
            # An image before the first frame's control chunk isn't part of the animation and is one frame more.
            frames, alone = frames + (not first_is_shown), True
        elif name == b"eXIf":
            turned = _orientation(body)
        at += 12 + length
    if size is None or frames < 1:
        raise ValueError("no header")
    return [_shown(*size, turned)] * frames


def _jpeg(data: bytes) -> list[Size]:
    at, turned = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        if marker in _FRAME_MARKERS:
            height, width = struct.unpack_from(">HH", data, at + 5)
            return [_shown(width, height, turned)]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(data[at + 4 : at + 2 + length])
        at += 2 + length
    raise ValueError("no frame")


def _webp(data: bytes) -> list[Size]:
    at, size, frames, turned = 12, None, 0, 1
    while at + 8 <= len(data):
        name, length = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + length]
        if name == b"VP8X":
            size = tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif name == b"VP8 " and size is None:
            size = tuple(v & 0x3FFF for v in struct.unpack_from("<HH", body, 6))
        elif name == b"VP8L" and size is None:
            bits = struct.unpack_from("<I", body, 1)[0]
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif name == b"ANMF":
            frames += 1
        elif name == b"EXIF":
            turned = _orientation(body)
        at += 8 + length + length % 2
    if size is None:
        raise ValueError("no header")
    return [_shown(*size, turned)] * max(1, frames)


def sizes(data: bytes) -> list[Size]:
    """Width and height of each frame as shown; ValueError, struct.error or KeyError for what is no such image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:2] in (b"II", b"MM"):
        found = [_shown(d.get(_WIDTH, 0), d.get(_HEIGHT, 0), d.get(_ORIENTATION, 1)) for d in _directories(data)]
        if found:
            return found
    raise ValueError("no image that is known")


def image_pages(sources: DataFrame) -> DataFrame:
    """Rows of PAGE, one a frame, for sources (batch_id, source_id, content): a point a pixel.

    A source that can't be read, null and empty content included, gives one row with
    ``error`` and a null index.
    """
    ship(sources.sparkSession)
    names = [f.split()[0] for f in PAGE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in batch.itertuples():
                try:
                    found = enumerate(sizes(s.content or b""))
                    rows += [(s.batch_id, s.source_id, i, float(w), float(h), None) for i, (w, h) in found]
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((s.batch_id, s.source_id, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=names).astype({"page_index": "Int32"})

    plain = sources.select(F.col("batch_id").cast("string"), F.col("source_id").cast("string"), "content")
    return plain.mapInPandas(run, PAGE)
