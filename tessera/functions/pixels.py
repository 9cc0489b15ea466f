"""Colour conversion and pixel packing, as Column expressions on integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: YCbCr to RGB in 12-bit fixed point; fixed values.
CR_TO_R, CB_TO_G, CR_TO_G, CB_TO_B = 5742, 1409, 2925, 7258


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def range_clip(v: Column) -> Column:
    """A sample from a signed value: 10 bits of it, raised by 128 and clamped; what doesn't fit in 10 bits wraps."""
    wrapped = (v.bitwiseAND(F.lit(1023)) + 512).bitwiseAND(F.lit(1023)) - 512
    return clamp(wrapped + 128)


def rgb_of(lum12: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """8-bit red, green, blue of a luma with 12 fractional bits."""
    r = F.shiftright(lum12 + CR_TO_R * (cr - 128), 12)
    g = F.shiftright(lum12 - CB_TO_G * (cb - 128) - CR_TO_G * (cr - 128), 12)
    b = F.shiftright(lum12 + CB_TO_B * (cb - 128), 12)
    return clamp(r), clamp(g), clamp(b)


def pack565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.bitwiseAND(F.lit(0xF8)), 8).bitwiseOR(F.shiftleft(g.bitwiseAND(F.lit(0xFC)), 3)).bitwiseOR(F.shiftright(b, 3))


def swap16(p: Column) -> Column:
    return F.shiftleft(p.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(p, 8))


def rgb565_le(lum: Column, cb: Column, cr: Column) -> Column:
    return pack565(*rgb_of(lum * 4096, cb, cr))


def rgb565_be(lum: Column, cb: Column, cr: Column) -> Column:
    return swap16(rgb565_le(lum, cb, cr))


def pack8888(r: Column, g: Column, b: Column) -> Column:
    """Bytes R, G, B, A in little-endian memory, alpha 255: a BIGINT."""
    return r.cast("long") + F.shiftleft(g.cast("long"), 8) + F.shiftleft(b.cast("long"), 16) + F.lit(255 << 24).cast("long")


def rgba8888(lum: Column, cb: Column, cr: Column) -> Column:
    return pack8888(*rgb_of(lum * 4096, cb, cr))


def gray565(lum: Column) -> Column:
    return pack565(lum, lum, lum)


def extend_bits(v: Column, size: Column) -> Column:
    """The signed value of ``size`` extra bits."""
    half = F.call_function("shiftleft", F.lit(1), F.greatest(size - 1, F.lit(0)))
    return F.when(size == 0, 0).when(v < half, v - 2 * half + 1).otherwise(v)


def point_transform(diff: Column, low: Column) -> Column:
    return F.call_function("shiftleft", diff, low)


def dither_level(gray: Column, bits: int) -> Column:
    return F.shiftright(gray, 8 - bits)


def green_bits(p565: Column) -> Column:
    return F.shiftright(p565.bitwiseAND(F.lit(0x7E0)), 5)


def unstuffed(data: Column) -> Column:
    """Bytes of a scan without stuffing: FF 00 to FF, FF with any other byte to nothing, both only at byte places."""
    spaced = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    whole = F.regexp_replace(spaced, "FF 00 ", "ff ")
    return F.unhex(F.replace(F.upper(F.regexp_replace(whole, "FF (?:[0-9A-F]{2} )?", "")), F.lit(" "), F.lit("")))
