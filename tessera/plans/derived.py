"""Images, rasters and blocks derived from ordinary tables, so that image operators can be queried and checked anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ycc(spark, sf_dir) -> DataFrame:
    """YCbCr values by line item; its keys aren't unique."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 5).cast("int").alias("lum"), (F.col("l_partkey") % 256).cast("int").alias("cb"), (F.col("l_suppkey") % 256).cast("int").alias("cr"))


def images(spark, sf_dir) -> DataFrame:
    """Image sizes, subsamplings, crop requests and decode options by part."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sub = F.element_at(F.array(*[F.lit(v) for v in (0x00, 0x11, 0x12, 0x21, 0x22)]), (key % 5 + 1).cast("int"))
    rows = part.select(key.alias("image_id"), (16 + 4 * F.col("p_size")).cast("int").alias("width"), (16 + 2 * (key % 37)).cast("int").alias("height"), sub.alias("subsample"))
    image = F.col("image_id")
    return rows.select(
        "*",
        ((image * 7) % F.col("width") - 8).cast("int").alias("req_x"),
        ((image * 13) % F.col("height") - 4).cast("int").alias("req_y"),
        (20 + image % 150).cast("int").alias("req_w"),
        (16 + image % 90).cast("int").alias("req_h"),
        (image % 7).cast("int").alias("pixel_type"),
        (1 + image % 40).cast("int").alias("max_mcus"),
        (image % 2 == 0).alias("dma"),
    )


def displays(spark, sf_dir) -> DataFrame:
    """Each image with the display of a supplier."""
    rows = images(spark, sf_dir)
    screens = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("display_id"), (40 + F.col("s_suppkey") * 17 % 220).cast("int").alias("display_w"), (30 + F.col("s_suppkey") * 11 % 160).cast("int").alias("display_h"))
    return rows.withColumn("display_id", F.col("image_id") % 10 + 1).join(screens, "display_id")


def raster(spark, sf_dir, wide: int = 64, high: int = 64) -> DataFrame:
    """Keyed pixels: the least value of the line items that fall on each."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("image_id"),
        ((F.col("l_orderkey") + F.col("l_partkey")) % high).cast("int").alias("y"),
        (F.col("l_partkey") % wide).cast("int").alias("x"),
        (F.col("l_quantity") * 5).cast("int").alias("lum"),
        (F.col("l_orderkey") % 256).cast("int").alias("cb"),
        (F.col("l_suppkey") * 3 % 256).cast("int").alias("cr"),
    )
    return rows.groupBy("image_id", "y", "x").agg(F.min("lum").alias("lum"), F.min("cb").alias("cb"), F.min("cr").alias("cr"))


def blocks(spark, sf_dir) -> DataFrame:
    """8 x 8 coefficient blocks in zig-zag order, with a quantization table each."""
    rows = table(spark, sf_dir, "embeddings")
    coefs = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("int"))
    quant = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda z: (3 + (F.col("vec_id") + 5 * z) % 30).cast("int"))
    return rows.select("vec_id", coefs.alias("coefs"), quant.alias("quant"))


def dc_stream(spark, sf_dir) -> DataFrame:
    """DC differences of images (users) in event order."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("image_id"), "event_id", (F.floor("value").cast("int") % 64 - 32).alias("dc_diff"), (F.floor("value").cast("int") % 12).alias("size"))
