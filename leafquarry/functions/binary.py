"""Numbers and signatures read from BINARY columns by Catalyst alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures of image files: name and hex digits at the start (dots stand for any digit).
SIGNATURES = (
    ("JPEG", "FFD8FF"), ("PNG", "89504E470D0A1A0A"), ("GIF", "474946383761"), ("GIF", "474946383961"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"),
    ("JP2", "0000000C6A502020"), ("JP2", "FF4FFF51"), ("JXR", "4949BC"), ("EXR", "762F3101"), ("BMP", "424D"), ("WEBP", "52494646........57454250"),
    ("ICO", "00000100"), ("PNM", "5031"), ("PNM", "5032"), ("PNM", "5033"), ("PNM", "5034"), ("PNM", "5035"), ("PNM", "5036"), ("RLE", "5234"), ("BPG", "425047FB"), ("PKM", "504B4D20"),
)


def piece(payload: Column, at: int | Column, n: int | Column) -> Column:
    """Bytes at .. at + n - 1, counted from 0."""
    return F.substring(payload, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(n) if isinstance(n, int) else n)


def unsigned(payload: Column, at: int, n: int, order: str = "big") -> Column:
    """An unsigned number of n bytes; null where the payload is too short."""
    digits = [F.hex(piece(payload, at + k, 1)) for k in range(n)]
    text = F.concat(*(digits if order == "big" else digits[::-1]))
    return F.when(F.length(payload) >= at + n, F.conv(text, 16, 10).cast("decimal(20,0)" if n == 8 else "bigint"))


def signed(payload: Column, at: int, n: int, order: str = "big") -> Column:
    u = unsigned(payload, at, n, order)
    return F.when(u >= 1 << 8 * n - 1, u - (1 << 8 * n)).otherwise(u)


def biased(payload: Column, at: int) -> Column:
    """A 16-bit number stored with 0x8000 added."""
    return unsigned(payload, at, 2) - 0x8000


def is_container(content: Column) -> Column:
    """At least 16 bytes that begin as a container file does."""
    return F.coalesce((F.length(content) >= 16) & (F.hex(piece(content, 0, 8)) == "41542654464F524D"), F.lit(False))


def has_magic(content: Column) -> Column:
    """The weaker test: the first four bytes alone."""
    return F.coalesce(F.hex(piece(content, 0, 4)) == "41542654", F.lit(False))


def sniff_format(content: Column) -> Column:
    """Name of the image format by signature, or null."""
    head, out = F.hex(piece(content, 0, 16)), None
    for name, digits in SIGNATURES:
        test = head.rlike("^" + digits)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def info_columns(p: Column) -> dict[str, Column]:
    """Fields of an INFO payload."""
    flag = unsigned(p, 9, 1).bitwiseAND(7)
    return {
        "width": unsigned(p, 0, 2).cast("int"), "height": unsigned(p, 2, 2).cast("int"),
        "version_major": unsigned(p, 5, 1).cast("int"), "version_minor": unsigned(p, 4, 1).cast("int"),
        "dpi": unsigned(p, 6, 2, "little").cast("int"), "gamma": (unsigned(p, 8, 1) / 10.0).cast("double"),
        "rotation": F.when(flag == 6, "CCW").when(flag == 2, "180").when(flag == 5, "CW").otherwise("NONE"),
        "rotation_code": F.when(flag == 6, 1).when(flag == 2, 2).when(flag == 5, 3).otherwise(0),
    }


def wavelet_columns(p: Column) -> dict[str, Column]:
    """Header of a wavelet chunk; version and size are in the first chunk alone."""
    first = unsigned(p, 0, 1) == 0
    only = lambda c: F.when(first, c)
    delay = F.coalesce(unsigned(p, 8, 1), F.lit(0))
    return {
        "serial": unsigned(p, 0, 1).cast("int"), "slices": unsigned(p, 1, 1).cast("int"), "major": only(unsigned(p, 2, 1).bitwiseAND(0x7F)).cast("int"),
        "minor": only(unsigned(p, 3, 1)).cast("int"), "is_color": only(unsigned(p, 2, 1).bitwiseAND(0x80) == 0),
        "width": only(unsigned(p, 4, 2)).cast("int"), "height": only(unsigned(p, 6, 2)).cast("int"),
        "crcb_delay": only(delay.bitwiseAND(0x7F)).cast("int"), "crcb_half": only(delay.bitwiseAND(0x80) == 0),
    }
