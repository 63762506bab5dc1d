"""Discovery from files to sources, and pages of images by their headers."""

import io
import struct
import zipfile
import zlib

import pytest

from sheaf.settings import Settings
from sheaf.sources import discovery, images


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width, height, *more):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"".join(more) + chunk(b"IEND", b"")


def tiff(*frames, order="<"):
    out, at = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8), 8
    for k, tags in enumerate(frames):
        size = 2 + 12 * len(tags) + 4
        out += struct.pack(order + "H", len(tags))
        for tag, value in tags.items():
            out += struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
        at += size
        out += struct.pack(order + "I", at if k + 1 < len(frames) else 0)
    return out


def jpeg(width, height, exif=b""):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif if exif else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0" + b"\xff\xd9"


def test_sizes_frames_and_rotation():
    assert images.sizes(png(30, 20)) == [(30, 20)]
    assert images.sizes(png(30, 20, chunk(b"eXIf", tiff({274: 6})))) == [(20, 30)]
    control, data = chunk(b"fcTL", b"\0" * 26), chunk(b"IDAT", b"")
    animated = chunk(b"acTL", struct.pack(">II", 2, 0))
    assert images.sizes(png(3, 2, animated, control, data, control)) == [(3, 2)] * 2
    assert images.sizes(png(3, 2, animated, data, control, control)) == [(3, 2)] * 3
    for order in "<>":
        assert images.sizes(tiff({256: 30, 257: 20}, {256: 5, 257: 9, 274: 8}, order=order)) == [(30, 20), (9, 5)]
    assert images.sizes(jpeg(40, 10)) == [(40, 10)]
    assert images.sizes(jpeg(40, 10, b"Exif\0\0" + tiff({274: 6}, order=">"))) == [(10, 40)]
    assert images.sizes(jpeg(40, 10, b"Exif\0\0damaged")) == [(40, 10)]
    extended = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    frame = b"ANMF" + struct.pack("<I", 1) + b"\0\0"
    assert images.sizes(b"RIFF\0\0\0\0WEBP" + extended + frame * 3) == [(30, 20)] * 3


@pytest.mark.parametrize("data", [b"", b"II", b"II*\0", png(0, 5), b"\xff\xd8\xff\xd9", b"RIFF\0\0\0\0WEBP", tiff({256: 3}), b"\xff\xd8nothing"])
def test_what_is_no_image(data):
    with pytest.raises((ValueError, KeyError, struct.error)):
        images.sizes(data)


def test_directories_in_a_circle_end():
    once = bytearray(tiff({256: 3, 257: 2}))
    once[-4:] = struct.pack("<I", 8)
    assert images.sizes(bytes(once)) == [(3, 2)]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "."), body)
    return out.getvalue()


def test_discovery_joins_files_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "work").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(png(30, 20))
    (tmp_path / "notes.txt").write_bytes(b"x")
    (tmp_path / "work" / "left.png").write_bytes(png(1, 1))
    (tmp_path / "v.xml").write_bytes(b"<a/>")
    inner = zipped(c__tif=tiff({256: 5, 257: 9}, {256: 4, 257: 4}), d__png=b"damaged")
    (tmp_path / "z.zip").write_bytes(zipped(copy__png=png(30, 20), in__zip=inner))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    sources, trouble = discovery.discover_sources(spark, str(tmp_path), "b", Settings(), work_dir=str(tmp_path / "work"))
    found = {(r.path.removeprefix(f"file:{tmp_path}/"), r.archive_member, r.depth, r.media_type) for r in sources.collect()}
    assert found == {
        ("sub/a.png", None, 0, "image/png"),
        ("v.xml", None, 0, "application/xml"),
        ("z.zip!in.zip", "c.tif", 2, "image/tiff"),
        ("z.zip!in.zip", "d.png", 2, "image/png"),
    }
    told = sorted((r.path.rsplit("/", 1)[-1], r.code) for r in trouble.collect())
    assert told == [("broken.zip", "archive_failed"), ("notes.txt", "unsupported_format")]
    assert [r.code for r in discovery.normalisation_issues(sources, images.image_pages(sources.where("false"))).collect()] == ["xml_requires_layout_companion"]
    read = images.image_pages(sources.where("media_type LIKE 'image/%'"))
    pages = read.collect()
    assert sorted(r.code for r in discovery.normalisation_issues(sources, read).collect()) == ["normalization_failed", "xml_requires_layout_companion"]
    assert sorted((r.page_index, r.width_pt, r.height_pt) for r in pages if r.error is None) == [(0, 5.0, 9.0), (0, 30.0, 20.0), (1, 4.0, 4.0)]
    assert [r.error for r in pages if r.page_index is None] == ["ValueError"]
    assert images.image_pages(sources.where("false")).count() == 0
