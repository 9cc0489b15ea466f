"""Scaling by aggregation and chroma upsampling by equi-joins on computed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chroma shifts in x and y of a subsampling.
SHIFTS = {0x11: (0, 0), 0x12: (0, 1), 0x21: (1, 0), 0x22: (1, 1)}


def _quads(raster: DataFrame):
    """Groups of 2 x 2 pixels; a group at an odd edge may have fewer."""
    return raster.groupBy("image_id", F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"))


def half_scale_gray(raster: DataFrame) -> DataFrame:
    """Whole 2 x 2 groups of lum, rounded."""
    return _quads(raster).agg(F.sum("lum").cast("int").alias("_sum"), F.count("*").alias("_n")).filter("_n = 4").select("image_id", "y", "x", F.shiftright(F.col("_sum") + 2, 2).alias("lum"))


def half_scale_colour(raster: DataFrame, subsample: int = 0x11) -> DataFrame:
    """``lum12`` (unrounded, 12 fractional bits), ``cb``, ``cr`` of whole 2 x 2 groups; chroma is averaged only where it is full in that direction.

    The raster has chroma per pixel; with a subsampling, pixels that share a chroma sample have the same.
    """
    sums = _quads(raster).agg(*[F.sum(c).cast("int").alias(c) for c in ("lum", "cb", "cr")], F.count("*").alias("_n"), *[F.sum(F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), F.col(c))).cast("int").alias(f"_{c}") for c in ("cb", "cr")])
    chroma = (lambda c: F.col(f"_{c}")) if subsample == 0x22 else (lambda c: F.shiftright(F.col(c) + 2, 2))
    return sums.filter("_n = 4").select("image_id", "y", "x", F.shiftleft("lum", 10).alias("lum12"), chroma("cb").alias("cb"), chroma("cr").alias("cr"))


def upsample(luma: DataFrame, chroma: DataFrame, subsample: int) -> DataFrame:
    """Luma pixels with the chroma sample that covers them (nearest): an equi-join on shifted coordinates.

    Pixels without a chroma sample get the neutral 128.
    """
    dx, dy = SHIFTS[subsample]
    keyed = luma.withColumns({"_cx": F.shiftright("x", dx), "_cy": F.shiftright("y", dy)})
    right = chroma.select(F.col("image_id").alias("_image"), F.col("x").alias("_x"), F.col("y").alias("_y"), "cb", "cr")
    joined = keyed.join(right, (F.col("image_id") == F.col("_image")) & (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")), "left")
    return joined.select("image_id", "y", "x", "lum", F.coalesce("cb", F.lit(128)).alias("cb"), F.coalesce("cr", F.lit(128)).alias("cr"))


def pack_bits(levels: DataFrame, bits: int) -> DataFrame:
    """Rows of level values to bytes, the leftmost pixel in the highest bits; a last partial byte is padded with zeros."""
    per = 8 // bits
    shift = 8 - bits - (F.col("x") % per) * bits
    return levels.groupBy("image_id", "y", F.floor(F.col("x") / per).cast("int").alias("byte_index")).agg(F.sum(F.call_function("shiftleft", F.col("level"), shift)).cast("int").alias("byte"))
