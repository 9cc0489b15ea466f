"""DC prediction and restart segments: one window per image, partitioned further by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import floor_div


def restart_segments(blocks: DataFrame, index_col: str, interval) -> DataFrame:
    """Adds segment_id: the restart interval that an MCU is in; 0 without intervals."""
    interval = F.lit(interval) if isinstance(interval, int) else F.col(interval)
    return blocks.withColumn("segment_id", F.when(interval > 0, floor_div(F.col(index_col), interval)).otherwise(0))


def predict_dc(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], diff_col: str = "dc_diff") -> DataFrame:
    """Adds dc: the running sum of differences within keys (image, component, segment).

    A segment is its own window partition, so a large image with restarts is summed by as many tasks as it has segments.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("dc", F.sum(diff_col).over(run))
