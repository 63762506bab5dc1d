"""Column expressions over file and archive member names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of supported suffixes, and device names that no member may have.
MEDIA_TYPES = {
    ".heic": "image/heic",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".ofd": "application/ofd",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".webp": "image/webp",
    ".xml": "application/xml",
}
DEVICES = ["aux", "con", "nul", "prn", *[f"com{n}" for n in range(1, 10)], *[f"lpt{n}" for n in range(1, 10)]]
#: Archive suffixes by kind.
ARCHIVES = {"zip": [".zip"], "7z": [".7z"], "rar": [".rar"], "tar": [".tar", ".tar.gz", ".tgz"]}


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    """Components with empty and ``.`` ones gone, as a POSIX path collapses them."""
    return F.filter(F.split(slashed(path), "/"), lambda p: (p != "") & (p != "."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(slashed(path), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("application/octet-stream"))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(list(MEDIA_TYPES))


def archive_kind(path: Column) -> Column:
    name, out = F.lower(basename(path)), F.lit(None).cast("string")
    for kind, ends in ARCHIVES.items():
        for end in ends:
            out = F.when(name.endswith(end), F.lit(kind)).otherwise(out)
    return out


def is_safe_member(name: Column) -> Column:
    """Whether an archive member's name is a portable relative path."""

    def fine(part: Column) -> Column:
        device = F.lower(F.element_at(F.split(part, r"\."), 1))
        return (part != "..") & ~part.contains(":") & (F.rtrim(part, F.lit(" .")) == part) & ~device.isin(DEVICES)

    return (
        (F.coalesce(name, F.lit("")) != "")
        & ~name.contains("\x00")
        & ~slashed(name).startswith("/")
        & ~name.rlike("^[A-Za-z]:")
        & F.forall(parts(name), fine)
    )


def member_key(name: Column) -> Column:
    """What two members that would be written to one place have in common; upper case in between folds what lower case leaves apart."""
    return F.array_join(F.transform(parts(name), lambda p: F.lower(F.upper(F.rtrim(p, F.lit(" ."))))), "/")


#: Fixed value: how absolute paths begin.
ABSOLUTE = r"^(?:/|\\\\|[A-Za-z]:[\\/])"


def is_absolute(path: Column) -> Column:
    return path.rlike(ABSOLUTE)


def is_path_field(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return plain.endswith("path")


def overlaps(a: Column, b: Column) -> Column:
    """Whether one path is the other or lies in it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))
