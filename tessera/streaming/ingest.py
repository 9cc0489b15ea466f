"""Decoding as a stream: files arrive in a folder, frames leave to a sink, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.images import decode_frames
from ..plans.options import DecodeOptions
from ..sources.files import stream_images


def stream_frames(spark: SparkSession, path: str, options: DecodeOptions | None = None) -> DataFrame:
    """Stateless: every file becomes a frame row; the checkpoint remembers which files are done."""
    return decode_frames(stream_images(spark, path), options)


def write_frames(frames: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    return frames.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
