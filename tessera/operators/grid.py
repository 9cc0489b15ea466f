"""MCU grids and tiles: generators and arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def mcu_grid(images: DataFrame) -> DataFrame:
    """One row per MCU of each image (columns width, height, subsample): adds mcu_index, mcu_x, mcu_y, row by row."""
    cx = G.ceil_div(F.col("width"), G.mcu_width(F.col("subsample")))
    cy = G.ceil_div(F.col("height"), G.mcu_height(F.col("subsample")))
    rows = images.filter(G.is_supported(F.col("subsample"))).withColumn("_cx", cx)
    rows = rows.withColumn("mcu_index", F.explode(F.sequence(F.lit(0), F.col("_cx") * cy - 1)))
    return rows.withColumns({"mcu_x": F.col("mcu_index") % F.col("_cx"), "mcu_y": G.floor_div(F.col("mcu_index"), F.col("_cx"))}).drop("_cx")


def mcus_in_crop(images: DataFrame) -> DataFrame:
    """The MCUs of ``crop`` only, generated as such: what lies outside is never made."""
    mw, mh, crop = G.mcu_width(F.col("subsample")), G.mcu_height(F.col("subsample")), F.col("crop")
    last = lambda at, size, mcu, image: G.floor_div(F.least(at + size, image) - 1, mcu)
    xs = F.sequence(G.floor_div(crop["x"], mw), last(crop["x"], crop["w"], mw, F.col("width")))
    ys = F.sequence(G.floor_div(crop["y"], mh), last(crop["y"], crop["h"], mh, F.col("height")))
    rows = images.filter(G.is_supported(F.col("subsample")) & (crop["w"] > 0) & (crop["h"] > 0)).withColumn("mcu_y", F.explode(ys))
    return rows.withColumn("mcu_x", F.explode(xs))


def with_component(blocks: DataFrame) -> DataFrame:
    """The component (0 luma, 1 Cb, 2 Cr) of each block of an MCU, from block_in_mcu and subsample."""
    luma = F.when(F.col("subsample") == 0x22, 4).when(F.col("subsample").isin(0x12, 0x21), 2).otherwise(1)
    return blocks.withColumn("component", F.greatest(F.lit(0), F.col("block_in_mcu") - luma + 1))


def tile_plan(images: DataFrame) -> DataFrame:
    """Adds tile_mcus, from width, subsample, crop, pixel_type, max_mcus and dma."""
    mw, mh = G.mcu_width(F.col("subsample")), G.mcu_height(F.col("subsample"))
    cx = G.ceil_div(F.col("width"), mw)
    return images.withColumn("tile_mcus", G.tile_mcus(cx, mw, mh, F.col("pixel_type"), F.col("max_mcus"), F.col("dma"), F.col("crop")["w"], F.col("width")))


def tile_geometry(plans: DataFrame) -> DataFrame:
    """One row per tile of a plan: adds tile_seq, x, y, tile_width, tile_height, width_used, buffer_slot.

    Places are relative to the crop. A tile's width is whole MCUs; width_used and tile_height end at the crop and the image.
    """
    mw, mh, crop = G.mcu_width(F.col("subsample")), G.mcu_height(F.col("subsample")), F.col("crop")
    rows = plans.filter(G.is_supported(F.col("subsample")) & (crop["w"] > 0) & (crop["h"] > 0)).withColumns({"_cols": G.ceil_div(crop["w"], mw), "_rows": G.ceil_div(crop["h"], mh)})
    rows = rows.withColumn("_per_row", G.ceil_div(F.col("_cols"), F.col("tile_mcus")))
    rows = rows.withColumn("tile_seq", F.explode(F.sequence(F.lit(0), F.col("_per_row") * F.col("_rows") - 1)))
    rows = rows.withColumns({"_tx": F.col("tile_seq") % F.col("_per_row"), "_ty": G.floor_div(F.col("tile_seq"), F.col("_per_row"))})
    rows = rows.withColumns({"x": F.col("_tx") * F.col("tile_mcus") * mw, "y": F.col("_ty") * mh})
    rows = rows.withColumn("tile_width", F.least(F.col("tile_mcus"), F.col("_cols") - F.col("_tx") * F.col("tile_mcus")) * mw)
    rows = rows.withColumn("width_used", F.least(F.col("tile_width"), crop["w"] - F.col("x"), F.col("width") - crop["x"] - F.col("x")))
    rows = rows.withColumn("tile_height", F.least(mh, crop["h"] - F.col("y"), F.col("height") - crop["y"] - F.col("y")))
    rows = rows.filter("width_used > 0 and tile_height > 0")
    return rows.withColumn("buffer_slot", F.when(F.col("dma"), F.col("tile_seq") % 2).otherwise(0)).drop("_cols", "_rows", "_per_row", "_tx", "_ty")


def sprites(placements: DataFrame) -> DataFrame:
    """Repeats an image over its display: x and y from 0 in steps of its size."""
    ys = F.sequence(F.lit(0), F.col("display_h") - 1, F.col("height"))
    return placements.withColumn("y", F.explode(ys)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("display_w") - 1, F.col("width"))))
