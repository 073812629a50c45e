"""File names, sizes, headers and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension, media kind, canonical format, and headers that fit.
FORMATS = (
    ("jpg", "image", "jpg", ("jpeg",)),
    ("jpeg", "image", "jpg", ("jpeg",)),
    ("png", "image", "png", ("png",)),
    ("bmp", "image", "bmp", ("bmp",)),
    ("webp", "image", "webp", ("webp",)),
    ("mp4", "video", "mp4", ("isobmff",)),
    ("mov", "video", "mov", ("isobmff", "quicktime")),
    ("avi", "video", "avi", ("avi",)),
    ("mkv", "video", "mkv", ("matroska",)),
    ("webm", "video", "webm", ("matroska",)),
)
MIN_HEADER = 12
BMP_HEADER_SIZES = (12, 16, 40, 52, 56, 64, 108, 124)
QUICKTIME_ATOMS = ("moov", "mdat", "free", "skip", "wide", "pnot")
DASH = "—"


def file_extension(name: Column) -> Column:
    """Lower-case extension without its dot, '' for none; a name of dots and a stem only has none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./\\][^/\\]*\.([^./\\]*)$", 1))


def media_kind(name: Column) -> Column:
    ext = file_extension(name)
    by = {k: [e for e, kind, _, _ in FORMATS if kind == k] for k in ("image", "video")}
    return F.when(ext.isin(*by["image"]), "image").when(ext.isin(*by["video"]), "video")


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024, one place from KB on, halves to the even digit, GB at most."""
    v = F.coalesce(n.cast("double"), F.lit(0.0))
    place = lambda unit, size: F.format_string(f"%.1f {unit}", F.bround(v / size, 1))
    return F.when(v < 1024, F.format_string("%d B", v.cast("bigint"))).when(v < 1024**2, place("KB", 1024)).when(v < 1024**3, place("MB", 1024**2)).otherwise(place("GB", 1024**3))


def sniff_format(header: Column) -> Column:
    """The container that leading bytes name, null for none or for fewer than 12 bytes."""
    h = F.hex(header)
    at = lambda start, size: F.substring(h, 2 * start + 1, 2 * size)
    hexed = lambda s: s.encode("latin-1").hex().upper()
    dib = at(14, 4)
    return (
        F.when(header.isNull() | (F.length(header) < MIN_HEADER), None)
        .when(at(0, 3) == "FFD8FF", "jpeg")
        .when(at(0, 8) == "89504E470D0A1A0A", "png")
        .when(at(0, 4) == hexed("RIFF"), F.when(at(8, 4) == hexed("AVI "), "avi").when(at(8, 4) == hexed("WEBP"), "webp"))
        .when(at(0, 4) == "1A45DFA3", "matroska")
        .when((at(0, 2) == hexed("BM")) & (F.length(header) >= 18), F.when(dib.isin(*(x.to_bytes(4, "little").hex().upper() for x in BMP_HEADER_SIZES)), "bmp"))
        .when(at(4, 4) == hexed("ftyp"), "isobmff")
        .when(at(4, 4).isin(*map(hexed, QUICKTIME_ATOMS)), "quicktime")
    )


def contains_literal(column: Column, term: str) -> Column:
    """Case-insensitive substring; wildcards stand for themselves."""
    return F.lower(column).contains(term.lower())


def normalise_email(column: Column) -> Column:
    return F.lower(F.trim(column))


def same_email(column: Column, address: str) -> Column:
    """Equality without regard to case; no other rule is applied."""
    return F.lower(column) == address.lower()


def email_ends_with(column: Column, suffix: str) -> Column:
    return F.lower(column).endswith(suffix.lower())


def token_reference(token: Column) -> Column:
    """Twelve hex digits that name a secret in a log and don't give it away."""
    return F.when(token.isNull() | (token == ""), "none").otherwise(F.substring(F.sha2(F.encode(token, "UTF-8"), 256), 1, 12))


def day_label(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def percent(v: Column) -> Column:
    return F.coalesce(F.format_string("%d%%", F.bround(v * 100).cast("bigint")), F.lit(DASH))


def seconds(v: Column) -> Column:
    return F.when(v.isNull(), DASH).otherwise(F.concat(F.format_string("%.1f", v), F.lit("s")))


def moment(v: Column) -> Column:
    return F.coalesce(F.date_format(v, "yyyy-MM-dd HH:mm:ss"), F.lit(DASH))


def truncate(v: Column, limit: int = 52) -> Column:
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.substring(v, 1, limit - 1), F.lit("…")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def confined(path: Column) -> Column:
    """Whether a relative path stays below its root: no root, drive, or step up."""
    p = F.regexp_replace(path, r"\\", "/")
    return ~(p.startswith("/") | p.rlike("^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)") | p.contains("\0"))


def rebase(path: Column, old: str, new: str) -> Column:
    """A path below one root as the same path below another; others stay."""
    return F.when(path.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(old.rstrip("/")) + 1), F.length(path)))).otherwise(path)
