"""The decode planner: options to the plan that does least."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import images as I  # noqa: N812
from .options import DecodeOptions, PixelType


def decode(images: DataFrame, options: DecodeOptions | None = None, output: str = "frames") -> DataFrame:
    """(image_id, content) rows to ``output``: info, blocks, samples, tiles, frames or bmp.

    info reads headers only; blocks and samples split images at restart markers; tiles and frames decode an image in one
    task and never make what scale, crop or a gray output doesn't need.
    """
    options = options or DecodeOptions()
    if output == "info":
        return I.image_info(images)
    if output in ("blocks", "samples"):
        # A segment is the unit of work: a large image with restarts spreads over the cluster.
        parts = I.segments(images).repartition("image_id", "segment_id")
        blocks = I.coef_blocks(parts)
        return blocks if output == "blocks" else I.sample_blocks(blocks, I.image_info(images))
    if output == "tiles":
        return I.decode_tiles(images, options)
    if output == "bmp":
        if options.pixel_type.value > PixelType.GRAY8.value:
            raise ValueError("bitmaps are not dithered")
        return I.bmp_files(I.decode_frames(images, options))
    if output == "frames":
        return I.decode_frames(images, options)
    raise ValueError(f"no output {output}")
