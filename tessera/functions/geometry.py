"""Geometry of MCUs, crops, tiles, scales and placement, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.options import CENTRE, SUBSAMPLINGS, TILE_PIXELS, PixelType


def mcu_width(subsample: Column) -> Column:
    return F.when(subsample.isin(0x21, 0x22), 16).when(subsample.isin(0x00, 0x11, 0x12), 8)


def mcu_height(subsample: Column) -> Column:
    return F.when(subsample.isin(0x12, 0x22), 16).when(subsample.isin(0x00, 0x11, 0x21), 8)


def is_supported(subsample: Column) -> Column:
    """Subsamplings with a defined MCU; all others are rejected as unsupported."""
    return subsample.isin(*SUBSAMPLINGS)


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def align_crop(width: Column, height: Column, subsample: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The effective rectangle of a crop request: MCU-aligned, as struct x, y, w, h.

    An overhanging request keeps the rule that its size becomes the image's less one MCU, whatever its origin.
    """
    mw, mh = mcu_width(subsample), mcu_height(subsample)
    wide, high = ceil_div(w, mw) * mw, ceil_div(h, mh) * mh
    left, top = F.least(F.greatest(x, F.lit(0)), width - mw), F.least(F.greatest(y, F.lit(0)), height - mh)
    wide, high = F.when(left + wide > width, width - mw).otherwise(wide), F.when(top + high > height, height - mh).otherwise(high)
    return F.struct((floor_div(left, mw) * mw).alias("x"), (floor_div(top, mh) * mh).alias("y"), wide.alias("w"), high.alias("h"))


def in_crop(mcu_x: Column, mcu_y: Column, mw: Column, mh: Column, crop: Column) -> Column:
    """Does the MCU at this grid place have pixels inside the rectangle? A range test, so it can sit on any scan of MCUs."""
    left, top = mcu_x * mw, mcu_y * mh
    return (left >= crop["x"]) & (left < crop["x"] + crop["w"]) & (top >= crop["y"]) & (top < crop["y"] + crop["h"])


def scale_shift(half: Column, quarter: Column, eighth: Column, progressive: Column) -> Column:
    """0 to 3 from the options: half before quarter before eighth; progressive images have eighth only."""
    return F.when(progressive, 3).when(half, 1).when(quarter, 2).when(eighth, 3).otherwise(0)


def fit_shift(w: Column, h: Column, display_w: Column, display_h: Column) -> Column:
    """The scale that brings an image to a display: more than 4 times larger: eighth, 2 times: quarter, else half."""
    over = lambda k: (w > display_w * k) | (h > display_h * k)
    return F.when(over(4), 3).when(over(2), 2).when(over(1), 1).otherwise(0)


def scaled(size: Column, shift: Column) -> Column:
    one = F.call_function("shiftleft", F.lit(1), shift)
    return F.call_function("shiftright", size + one - 1, shift)


def centred(at: Column, image: Column, display: Column) -> Column:
    """A placement; CENTRE becomes the middle, or 0 where the image is larger."""
    return F.when(at == CENTRE, F.greatest(F.lit(0), floor_div(display - image, 2))).otherwise(at)


def placement_error(at: Column, image: Column, display: Column) -> Column:
    """True where a placement would need clipping, which a display doesn't do."""
    return (at != CENTRE) & ((at < 0) | (at + image > display))


def tile_mcus(cx: Column, mw: Column, mh: Column, pixel_type: Column, max_mcus: Column, dma: Column, crop_w: Column, width: Column) -> Column:
    """MCUs in a tile: as many as the pixel buffer holds, by pixel type, bounds and crop; a whole row for dithering."""
    fits = floor_div(F.lit(TILE_PIXELS), mw * mh)
    fits = F.when(pixel_type == PixelType.RGB8888.value, floor_div(fits, 2)).when(pixel_type == PixelType.GRAY8.value, fits * 2).otherwise(fits)
    fits = F.least(fits, cx)
    fits = F.when(fits > max_mcus, max_mcus).when(dma, floor_div(fits, 2)).otherwise(fits)
    fits = F.when(pixel_type > PixelType.GRAY8.value, cx).otherwise(fits)
    fits = F.when((crop_w != width) & (fits * mw > crop_w), floor_div(crop_w, mw)).otherwise(fits)
    return F.greatest(fits, F.lit(1))


def tiff_short(hex4: Column, little: Column) -> Column:
    """A 16-bit value of 4 hex digits, in either byte order."""
    return F.conv(F.when(little, F.concat(F.substring(hex4, 3, 2), F.substring(hex4, 1, 2))).otherwise(hex4), 16, 10).cast("int")


def tiff_long(hex8: Column, little: Column) -> Column:
    turned = F.concat(*[F.substring(hex8, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(F.when(little, turned).otherwise(hex8), 16, 10).cast("long")


def jpeg_type(sof: Column) -> Column:
    return F.when(sof == 0xC2, "PROGRESSIVE").otherwise("BASELINE")
