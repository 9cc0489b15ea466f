"""Images encoded in memory, from the rows of a table: sizes, subsamplings, restarts, thumbnails and a few broken files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def encoded(key: int) -> bytes:
    """The image of a key; deterministic. One in 16 is cut short, one in 32 is no image."""
    from ..codec.encoder import encode, exif_segment, picture

    sub = (0x00, 0x11, 0x12, 0x21, 0x22)[key % 5]
    wide, high = 24 + key * 7 % 60, 20 + key * 11 % 50
    planes = picture(key, wide, high)
    app1 = b""
    if key % 4 == 1:
        thumb = encode(picture(key + 1, 16, 16), 0x11) if key % 8 == 1 else None
        app1 = exif_segment("little" if key % 3 else "big", 1 + key % 8, thumb, (16, 16))
    data = encode(planes[:1] if sub == 0 else planes, sub, 60 + key % 35, key % 6, key % 7 == 3, app1, key % 9 == 2)
    if key % 32 == 31:
        return b"GIF89a" + data[6:]
    return data[: len(data) * 2 // 3] if key % 16 == 15 else data


def mosaic(key: int) -> bytes:
    """An image of flat blocks: whatever it decodes to follows from its key by arithmetic.

    Value of component c in its block (x, y): (31 key + 57 c + 17 x + 23 y) mod 256, luma blocks being 8 x 8 pixels and
    chroma blocks an MCU. The quantization step of a DC is 1, so values come back exactly.
    """
    import numpy as np

    from ..codec.encoder import encode, exif_segment

    sub = (0x00, 0x11, 0x12, 0x21, 0x22)[key % 5]
    wide, high = 9 + key * 7 % 40, 6 + key * 11 % 30
    y, x = np.mgrid[0:high, 0:wide]
    value = lambda c, w, h: ((31 * key + 57 * c + x // w * 17 + y // h * 23) % 256).astype(np.uint8)
    mcu = 16 if sub in (0x21, 0x22) else 8, 16 if sub in (0x12, 0x22) else 8
    planes = [value(0, 8, 8), *([value(c, *mcu) for c in (1, 2)] if sub else [])]
    return encode(planes, sub, 97, key % 4, False, exif_segment("little" if key % 2 else "big", 1 + key % 8, None) if key % 3 == 1 else b"")


#: Images that are made before they are handed on.
CHUNK = 64


def made(frames, make):
    """Frames of image_id to frames of (image_id, content), CHUNK images at a time, however many a frame has."""
    for frame in frames:
        for at in range(0, len(frame), CHUNK):
            ids = frame["image_id"].iloc[at : at + CHUNK]
            yield pd.DataFrame({"image_id": ids, "content": [make(k) for k in ids]})


def synthetic_images(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey", make=encoded) -> DataFrame:
    """``image_id, content``, one image per row of the table."""
    ship(spark)
    keys = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("image_id"))
    return keys.repartition(spark.sparkContext.defaultParallelism, "image_id").mapInPandas(lambda frames: made(frames, make), "image_id long, content binary")
