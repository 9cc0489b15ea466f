"""From encoded bytes to rows: header columns, segments, coefficient blocks, samples, frames, tiles."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..plans.options import DecodeOptions, Mode, Status
from ..shipping import ship
from .prediction import predict_dc

INFO = """status string, error_code int, width int, height int, bpp int, subsample int, mode string, num_components int, orientation int,
 has_thumb boolean, thumb_width int, thumb_height int, thumb_offset long, restart_interval int, scan_start int, scan_end int, approx_low int, approx_high int,
 components array<struct<id:int,index:int,h:int,v:int,quant:int,dc:int,ac:int>>, quant map<int,array<int>>, huff array<struct<cls:int,id:int,lengths:array<int>,symbols:binary>>, scan_offset long"""


def _info(content: bytes) -> dict:
    from ..codec.header import Bad, parse

    try:
        h = parse(content)
    except Bad as e:
        return {"status": e.status.name, "error_code": int(e.status)}
    return {
        "status": Status.SUCCESS.name, "error_code": 0, "width": h.width, "height": h.height, "bpp": h.bpp, "subsample": h.subsample, "mode": "PROGRESSIVE" if h.progressive else "BASELINE",
        "num_components": len(h.components), "orientation": h.orientation, "has_thumb": h.has_thumb, "thumb_width": h.thumb_width, "thumb_height": h.thumb_height, "thumb_offset": h.thumb_offset,
        "restart_interval": h.restart_interval, "scan_start": h.scan_start, "scan_end": h.scan_end, "approx_low": h.approx_low, "approx_high": h.approx_high,
        "components": [{"id": c.id, "index": c.index, "h": c.h, "v": c.v, "quant": c.quant, "dc": c.dc, "ac": c.ac} for c in h.components], "quant": [*h.quant.items()],
        "huff": [{"cls": k, "id": n, "lengths": list(lengths), "symbols": bytes(symbols)} for (k, n), (lengths, symbols) in sorted(h.huff.items())], "scan_offset": h.scan_offset,
    }


#: Rows, and bytes of their values, that are handed on together. A batch ends with the row that reaches either.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20


def _mapped(df: DataFrame, row, schema: str) -> DataFrame:
    """Rows of df to any number of rows, streamed in small Arrow batches; ``row`` gets a row and yields tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _streamed(batches, row, arrow), schema)


def _streamed(batches, row, schema):
    """Beside the batch that came in, a worker holds one row's values and at most a batch of results, however many rows a task has."""
    import pyarrow as pa

    for batch in batches:
        names, out, size = batch.schema.names, [], 0
        for k in range(batch.num_rows):
            for made in row(SimpleNamespace(**{n: c[k].as_py() for n, c in zip(names, batch.columns, strict=True)})):
                out.append(made)
                size += sum(len(v) * (8 if isinstance(v, list) else 1) for v in made if isinstance(v, (bytes, str, list)))
                if len(out) == BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(pa, out, schema)
                    out, size = [], 0
        yield _batch(pa, out, schema)


def _batch(pa, rows: list[tuple], schema):
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def image_info(images: DataFrame) -> DataFrame:
    """``image_id`` and the header's columns of (image_id, content) rows. Whatever isn't an image has a status and nulls."""
    names = [f.name for f in images.sparkSession.createDataFrame([], INFO).schema]

    def row(item):
        info = _info(item.content)
        yield (item.image_id, *[info.get(n) for n in names])

    return _mapped(images.select("image_id", "content"), row, f"image_id long, {INFO}")


def segments(images: DataFrame) -> DataFrame:
    """Restart intervals of images that can be decoded: ``image_id, segment_id, first_mcu, n_mcus, head, data``.

    ``head`` is the file up to the scan without application data and comments: all that a task needs to decode a segment
    wherever it runs.
    """

    def row(item):
        from ..codec.entropy import checked
        from ..codec.entropy import segments as split
        from ..codec.header import Bad, bare, parse

        content = item.content
        try:
            h = parse(content)
            cx, cy = h.grid
            # A segment's task holds no more than the segment.
            checked(h, len(content) - h.scan_offset, min(cx * cy, h.restart_interval or cx * cy))
        except Bad:
            return
        head = bare(content, h.scan_offset)
        step = h.restart_interval or cx * cy
        for k, (first, data) in enumerate(zip(range(0, cx * cy, step), split(content, h), strict=False)):
            yield item.image_id, k, first, min(step, cx * cy - first), head, data

    return _mapped(images.select("image_id", "content"), row, "image_id long, segment_id int, first_mcu int, n_mcus int, head binary, data binary")


def coef_blocks(parts: DataFrame) -> DataFrame:
    """Coefficient blocks of segments, DC still differential: ``image_id, segment_id, mcu_index, mcu_x, mcu_y, component, block_in_mcu, quant_id, dc_diff, coefs``."""

    def row(item):
        from ..codec.entropy import decode_segment
        from ..codec.header import parse

        h = parse(bytes(item.head).ljust(256, b"\0"))
        found, whole = decode_segment(bytes(item.data), h, item.n_mcus)
        cx, luma, none = h.grid[0], h.luma_blocks, [0] * (64 - found.shape[2])
        for m in range(whole):
            at = item.first_mcu + m
            for b in range(found.shape[1]):
                c = max(0, b - luma + 1)
                yield item.image_id, item.segment_id, at, at % cx, at // cx, c, b, h.components[c].quant, int(found[m, b, 0]), found[m, b].tolist() + none

    schema = "image_id long, segment_id int, mcu_index int, mcu_x int, mcu_y int, component int, block_in_mcu int, quant_id int, dc_diff int, coefs array<int>"
    return _mapped(parts, row, schema)


def _transformed(dc: pd.Series, coefs: pd.Series, quant: pd.Series) -> pd.Series:
    """Samples of blocks, by array operations over a batch; blocks of one table are transformed together."""
    import numpy as np

    from ..codec.tables import clip, idct

    block = np.stack(coefs.to_list()).astype(np.int64)
    block[:, 0] = dc
    table = np.stack(quant.to_list()).astype(np.int64)
    out = np.repeat(clip((block[:, :1] * table[:, :1]) >> 5), 64, axis=1)
    full = block[:, 1:].any(axis=1)  # blocks of a DC alone need no transform
    if full.any():
        out[full] = idct(block[full] * table[full])
    return pd.Series([*out.astype(np.int32)])


def sample_blocks(blocks: DataFrame, info: DataFrame) -> DataFrame:
    """Samples of coefficient blocks: DC by a window, quantization tables by a join on (image, table), then the transform."""
    ship(blocks.sparkSession)
    predicted = predict_dc(blocks, ["image_id", "component", "segment_id"], ["mcu_index", "block_in_mcu"])
    tables = info.filter("error_code = 0").select(F.col("image_id").alias("_image"), F.explode("quant").alias("_table", "_q")).select("_image", "_table", B.prescaled(F.col("_q")).alias("_quant"))
    rows = predicted.join(tables, (F.col("image_id") == F.col("_image")) & (F.col("quant_id") == F.col("_table")))
    return rows.select("image_id", "mcu_index", "mcu_x", "mcu_y", "component", "block_in_mcu", F.pandas_udf(_transformed, "array<int>")("dc", "coefs", "_quant").alias("samples"))


def decode_frames(images: DataFrame, options: DecodeOptions | None = None) -> DataFrame:
    """One row per image: ``image_id, status, error_code, width, height, pixel_type, data``: the whole decode in one task per image.

    PERMISSIVE keeps every image with its status and what could be decoded; DROPMALFORMED drops images that failed;
    FAILFAST raises. Options choose the plan: scale, crop and luma reach down to what is stored and transformed at all.
    """
    options = options or DecodeOptions()

    def row(item):
        from ..codec.decode import decode_frame, frame_bytes

        frame = decode_frame(item.content, options)
        if frame.status is not Status.SUCCESS:
            if options.mode is Mode.FAILFAST:
                raise ValueError(f"image {item.image_id}: {frame.status.name}")
            if options.mode is Mode.DROPMALFORMED:
                return
        yield item.image_id, frame.status.name, int(frame.status), frame.width, frame.height, options.pixel_type.name, frame_bytes(frame, options)

    return _mapped(images.select("image_id", "content"), row, "image_id long, status string, error_code int, width int, height int, pixel_type string, data binary")


def decode_tiles(images: DataFrame, options: DecodeOptions | None = None) -> DataFrame:
    """One row per tile, in drawing order by tile_seq; tiles before a failure stay, and carry the image's status."""
    options = options or DecodeOptions()

    def row(item):
        from ..codec.decode import decode_frame, tiles

        frame = decode_frame(item.content, options)
        if frame.status is not Status.SUCCESS and options.mode is not Mode.PERMISSIVE:
            if options.mode is Mode.FAILFAST:
                raise ValueError(f"image {item.image_id}: {frame.status.name}")
            return
        for t in tiles(frame, options):
            yield (item.image_id, frame.status.name, *t, t[0] % 2 if options.dma else 0)

    return _mapped(images.select("image_id", "content"), row, "image_id long, status string, tile_seq int, x int, y int, width int, height int, width_used int, bpp int, pixels binary, buffer_slot int")


def bmp_files(frames: DataFrame) -> DataFrame:
    """``image_id, bmp`` of frames (not dithered ones): a bitmap file each."""

    def row(item):
        import numpy as np

        from ..codec.decode import bmp
        from ..plans.options import PixelType

        kind = PixelType[item.pixel_type]
        dtype = {PixelType.RGB8888: "<u4", PixelType.RGB565_LE: "<u2", PixelType.RGB565_BE: ">u2"}.get(kind, "u1")
        if item.width:
            yield item.image_id, bmp(np.frombuffer(bytes(item.data), dtype).reshape(item.height, item.width), kind)

    return _mapped(frames.select("image_id", "width", "height", "pixel_type", "data"), row, "image_id long, bmp binary")


def assemble(tiles: DataFrame, bytes_per_pixel: int) -> DataFrame:
    """Frames of tiles, in Column expressions: tiles split into lines, lines in order, one binary per image: ``image_id, width, height, data``."""
    line = F.posexplode(F.sequence(F.lit(0), F.col("height") - 1)).alias("line", "_k")
    rows = tiles.select("image_id", "x", "y", "width_used", "height", "pixels", line)
    size = F.col("width_used") * bytes_per_pixel
    rows = rows.select("image_id", "x", (F.col("y") + F.col("line")).alias("y"), "width_used", F.expr(f"substring(pixels, line * width_used * {bytes_per_pixel} + 1, width_used * {bytes_per_pixel})").alias("part"), size.alias("_size"))
    parts = F.array_sort(F.collect_list(F.struct("y", "x", "part")))
    grouped = rows.groupBy("image_id").agg(F.max(F.col("x") + F.col("width_used")).alias("width"), (F.max("y") + 1).alias("height"), parts.alias("_parts"))
    return grouped.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["part"])), "")).alias("data"))


def dither(gray_rows: DataFrame, bits: int) -> DataFrame:
    """Error diffusion over (image_id, y, gray binary) rows: ``image_id, y, packed``. Serial within an image, parallel over images."""
    ship(gray_rows.sparkSession)

    def run(frame):
        import numpy as np

        from ..codec.decode import dithered

        frame = frame.sort_values("y")
        image = np.stack([np.frombuffer(bytes(g), np.uint8) for g in frame["gray"]])
        return pd.DataFrame({"image_id": frame["image_id"], "y": frame["y"], "packed": [row.tobytes() for row in dithered(image, bits)]})

    return gray_rows.groupBy("image_id").applyInPandas(run, "image_id long, y int, packed binary")


def client_dither(tiles: DataFrame) -> DataFrame:
    """565 tiles to a byte per pixel of four levels: ``image_id, tile_seq, width_used, height, levels``."""

    def row(item):
        import numpy as np

        from ..codec.decode import client_dithered

        pixels = np.frombuffer(item.pixels, "<u2").reshape(item.height, item.width_used)
        yield item.image_id, item.tile_seq, item.width_used, item.height, client_dithered((pixels & 0x7E0) >> 5).tobytes()

    return _mapped(tiles.select("image_id", "tile_seq", "width_used", "height", "pixels"), row, "image_id long, tile_seq int, width_used int, height int, levels binary")
