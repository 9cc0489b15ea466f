"""Every image operator as a query on derived tables, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import geometry as G
from ..functions import pixels as P
from ..operators import grid, prediction, resample
from . import derived
from .options import CENTRE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query of its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# The derived tables in SQL.
YCC = "ycc AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 5 AS INTEGER) AS lum, CAST(l_partkey % 256 AS INTEGER) AS cb, CAST(l_suppkey % 256 AS INTEGER) AS cr FROM lineitem)"
CLAMPED = "greatest(0, least(255, {}))"
RGB = f"""rgb AS (SELECT *, {CLAMPED.format("(lum * 4096 + 5742 * (cr - 128)) >> 12")} AS r,
  {CLAMPED.format("(lum * 4096 - 1409 * (cb - 128) - 2925 * (cr - 128)) >> 12")} AS g, {CLAMPED.format("(lum * 4096 + 7258 * (cb - 128)) >> 12")} AS b"""
PACK = "(((r & 248) << 8) | ((g & 252) << 3) | (b >> 3))"
IMAGES = """images AS (SELECT *, CAST((image_id * 7) % width - 8 AS INTEGER) AS req_x, CAST((image_id * 13) % height - 4 AS INTEGER) AS req_y,
  CAST(20 + image_id % 150 AS INTEGER) AS req_w, CAST(16 + image_id % 90 AS INTEGER) AS req_h, CAST(image_id % 7 AS INTEGER) AS pixel_type,
  CAST(1 + image_id % 40 AS INTEGER) AS max_mcus, image_id % 2 = 0 AS dma,
  CASE WHEN subsample IN (33, 34) THEN 16 ELSE 8 END AS mw, CASE WHEN subsample IN (18, 34) THEN 16 ELSE 8 END AS mh
  FROM (SELECT p_partkey AS image_id, CAST(16 + 4 * p_size AS INTEGER) AS width, CAST(16 + 2 * (p_partkey % 37) AS INTEGER) AS height,
    CAST([0, 17, 18, 33, 34][p_partkey % 5 + 1] AS INTEGER) AS subsample FROM part))"""
CROPS = f"""{IMAGES}, sized AS (SELECT *, ((req_w + mw - 1) // mw) * mw AS w0, ((req_h + mh - 1) // mh) * mh AS h0,
    least(greatest(req_x, 0), width - mw) AS x0, least(greatest(req_y, 0), height - mh) AS y0 FROM images),
  crops AS (SELECT *, CAST(x0 // mw * mw AS INTEGER) AS cx0, CAST(y0 // mh * mh AS INTEGER) AS cy0,
    CAST(CASE WHEN x0 + w0 > width THEN width - mw ELSE w0 END AS INTEGER) AS cw, CAST(CASE WHEN y0 + h0 > height THEN height - mh ELSE h0 END AS INTEGER) AS ch FROM sized)"""
PLANS = f"""{CROPS}, f1 AS (SELECT *, (width + mw - 1) // mw AS cx,
    CASE pixel_type WHEN 2 THEN 2048 // (mw * mh) // 2 WHEN 3 THEN 2048 // (mw * mh) * 2 ELSE 2048 // (mw * mh) END AS fits FROM crops),
  f2 AS (SELECT * REPLACE (least(fits, cx) AS fits) FROM f1),
  f3 AS (SELECT * REPLACE (CASE WHEN fits > max_mcus THEN max_mcus WHEN dma THEN fits // 2 ELSE fits END AS fits) FROM f2),
  f4 AS (SELECT * REPLACE (CASE WHEN pixel_type > 3 THEN cx ELSE fits END AS fits) FROM f3),
  plans AS (SELECT *, CAST(greatest(1, CASE WHEN cw <> width AND fits * mw > cw THEN cw // mw ELSE fits END) AS INTEGER) AS tile_mcus FROM f4)"""
DISPLAYS = f"""{IMAGES}, shown AS (SELECT i.*, CAST(40 + s_suppkey * 17 % 220 AS INTEGER) AS display_w, CAST(30 + s_suppkey * 11 % 160 AS INTEGER) AS display_h
  FROM images i JOIN supplier ON image_id % 10 + 1 = s_suppkey)"""
RASTER = """raster AS (SELECT image_id, y, x, min(lum) AS lum, min(cb) AS cb, min(cr) AS cr FROM (
  SELECT l_linenumber AS image_id, CAST((l_orderkey + l_partkey) % {high} AS INTEGER) AS y, CAST(l_partkey % {wide} AS INTEGER) AS x,
    CAST(l_quantity * 5 AS INTEGER) AS lum, CAST(l_orderkey % 256 AS INTEGER) AS cb, CAST(l_suppkey * 3 % 256 AS INTEGER) AS cr FROM lineitem) GROUP BY ALL)"""
RASTER64 = RASTER.format(high=64, wide=64)
BLOCKS = """blocks AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 64) AS INTEGER)) AS coefs,
  list_transform(range(64), lambda z: CAST(3 + (vec_id + 5 * z) % 30 AS INTEGER)) AS quant FROM embeddings)"""
PLACES = f"{[p + 1 for p in B.PLACE]}"
NATURAL = f"""{BLOCKS}, natural_blocks AS (SELECT vec_id, list_transform({PLACES}, lambda k: coefs[k]) AS coefs,
  list_transform(range(1, 65), lambda k: (quant[{PLACES}[k]] * {B.AAN}[k]) >> 12) AS quant FROM blocks),
  dequantized AS (SELECT vec_id, list_transform(range(1, 65), lambda k: coefs[k] * quant[k]) AS d FROM natural_blocks)"""
CLIP = "greatest(0, least(255, (((({}) & 1023) + 512) & 1023) - 512 + 128))"
DC = "stream AS (SELECT user_id AS image_id, event_id, CAST(floor(value) AS INTEGER) % 64 - 32 AS dc_diff, CAST(floor(value) AS INTEGER) % 12 AS size FROM events)"


def _numbered(array: Column, name: str) -> list[Column]:
    return [F.posexplode(array).alias("position", name)]


# ---- colour and pixels


@query(f"WITH {YCC}, {RGB} FROM ycc) SELECT l_orderkey, l_linenumber, lum, cb, cr, CAST({PACK} AS INTEGER) AS rgb565 FROM rgb")
def rgb565_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ycc(spark, sf_dir).withColumn("rgb565", P.rgb565_le(F.col("lum"), F.col("cb"), F.col("cr")))


@query(f"WITH {YCC}, {RGB} FROM ycc), p AS (SELECT *, {PACK} AS v FROM rgb) SELECT l_orderkey, l_linenumber, lum, cb, cr, CAST(((v & 255) << 8) | (v >> 8) AS INTEGER) AS rgb565 FROM p")
def rgb565_be(spark, sf_dir):
    return derived.ycc(spark, sf_dir).withColumn("rgb565", P.rgb565_be(F.col("lum"), F.col("cb"), F.col("cr")))


@query(f"WITH {YCC}, {RGB} FROM ycc) SELECT l_orderkey, l_linenumber, lum, cb, cr, CAST(r + g * 256 + b * 65536 + 4278190080 AS BIGINT) AS rgba FROM rgb")
def rgba8888(spark, sf_dir):
    return derived.ycc(spark, sf_dir).withColumn("rgba", P.rgba8888(F.col("lum"), F.col("cb"), F.col("cr")))


@query(f"WITH {YCC}, rgb AS (SELECT *, lum AS r, lum AS g, lum AS b FROM ycc) SELECT l_orderkey, l_linenumber, lum, CAST({PACK} AS INTEGER) AS rgb565, CAST(({PACK} & 255) << 8 | ({PACK} >> 8) AS INTEGER) AS rgb565_be, CAST(lum + lum * 256 + lum * 65536 + 4278190080 AS BIGINT) AS rgba FROM rgb")
def gray565(spark, sf_dir):
    lum = F.col("lum")
    packed = P.gray565(lum)
    return derived.ycc(spark, sf_dir).select("l_orderkey", "l_linenumber", "lum", packed.alias("rgb565"), P.swap16(packed).alias("rgb565_be"), P.pack8888(lum, lum, lum).alias("rgba"))


@query(f"WITH {YCC} SELECT l_orderkey, l_linenumber, lum AS gray FROM ycc")
def luma_only(spark, sf_dir):
    return derived.ycc(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("lum").alias("gray"))


@query(f"WITH {YCC} SELECT l_orderkey, l_linenumber, v, CAST({CLIP.format('v')} AS INTEGER) AS sample FROM (SELECT *, lum * 7 - cb * 3 - 200 AS v FROM ycc)")
def range_clip(spark, sf_dir):
    rows = derived.ycc(spark, sf_dir).withColumn("v", F.col("lum") * 7 - F.col("cb") * 3 - 200)
    return rows.select("l_orderkey", "l_linenumber", "v", P.range_clip(F.col("v")).alias("sample"))


@query(f"WITH {YCC}, {RGB} FROM ycc), p AS (SELECT *, {PACK} AS v FROM rgb) SELECT l_orderkey, l_linenumber, CAST((v & 2016) >> 5 AS INTEGER) AS green FROM p")
def green_channel(spark, sf_dir):
    return derived.ycc(spark, sf_dir).select("l_orderkey", "l_linenumber", P.green_bits(P.rgb565_le(F.col("lum"), F.col("cb"), F.col("cr"))).alias("green"))


# ---- geometry


def _cropped(spark, sf_dir):
    rows = derived.images(spark, sf_dir)
    return rows.withColumn("crop", G.align_crop(*[F.col(c) for c in ("width", "height", "subsample", "req_x", "req_y", "req_w", "req_h")]))


@query(f"WITH {CROPS} SELECT image_id, width, height, subsample, cx0 AS crop_x, cy0 AS crop_y, cw AS crop_w, ch AS crop_h FROM crops")
def crop_align(spark, sf_dir):
    return _cropped(spark, sf_dir).select("image_id", "width", "height", "subsample", *[F.col(f"crop.{c}").alias(f"crop_{c}") for c in "xywh"])


GRID = "grid AS (SELECT *, mcu_index % cx AS mcu_x, mcu_index // cx AS mcu_y FROM (SELECT *, CAST(unnest(range(cx * cy)) AS INTEGER) AS mcu_index FROM (SELECT *, (width + mw - 1) // mw AS cx, (height + mh - 1) // mh AS cy FROM {})))"


@query(f"WITH {CROPS}, {GRID.format('crops')} SELECT image_id, CAST(mcu_x AS INTEGER) AS mcu_x, CAST(mcu_y AS INTEGER) AS mcu_y FROM grid WHERE mcu_x * mw >= cx0 AND mcu_x * mw < cx0 + cw AND mcu_y * mh >= cy0 AND mcu_y * mh < cy0 + ch")
def crop_mcu_filter(spark, sf_dir):
    """Generated from the crop: the whole grid is never made."""
    return grid.mcus_in_crop(_cropped(spark, sf_dir)).select("image_id", "mcu_x", "mcu_y")


@query(f"WITH {IMAGES}, {GRID.format('images')} SELECT image_id, mcu_index, CAST(mcu_x AS INTEGER) AS mcu_x, CAST(mcu_y AS INTEGER) AS mcu_y FROM grid")
def mcu_grid(spark, sf_dir):
    return grid.mcu_grid(derived.images(spark, sf_dir)).select("image_id", "mcu_index", "mcu_x", "mcu_y")


@query(f"""WITH {IMAGES}, n AS (SELECT image_id, subsample, CASE WHEN subsample = 34 THEN 4 WHEN subsample IN (18, 33) THEN 2 ELSE 1 END AS luma FROM images),
 b AS (SELECT *, CAST(unnest(range(CASE WHEN subsample = 0 THEN 1 ELSE luma + 2 END)) AS INTEGER) AS block_in_mcu FROM n)
 SELECT image_id, subsample, block_in_mcu, CAST(greatest(0, block_in_mcu - luma + 1) AS INTEGER) AS component FROM b""")
def component_dispatch(spark, sf_dir):
    blocks = F.when(F.col("subsample") == 0, 1).when(F.col("subsample") == 0x22, 6).when(F.col("subsample") == 0x11, 3).otherwise(4)
    rows = derived.images(spark, sf_dir).select("image_id", "subsample", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block_in_mcu"))
    return grid.with_component(rows)


@query(f"WITH {PLANS} SELECT image_id, subsample, pixel_type, max_mcus, dma, tile_mcus FROM plans")
def tile_plan(spark, sf_dir):
    return grid.tile_plan(_cropped(spark, sf_dir)).select("image_id", "subsample", "pixel_type", "max_mcus", "dma", "tile_mcus")


TILES = f"""{PLANS}, t1 AS (SELECT *, (cw + mw - 1) // mw AS cols, (ch + mh - 1) // mh AS nrows FROM plans),
  t2 AS (SELECT *, (cols + tile_mcus - 1) // tile_mcus AS per_row FROM t1),
  t3 AS (SELECT *, CAST(unnest(range(per_row * nrows)) AS INTEGER) AS tile_seq FROM t2),
  t4 AS (SELECT *, tile_seq % per_row AS tx, tile_seq // per_row AS ty FROM t3),
  t5 AS (SELECT *, tx * tile_mcus * mw AS x, ty * mh AS y, least(tile_mcus, cols - tx * tile_mcus) * mw AS tile_width FROM t4),
  tiles AS (SELECT *, least(tile_width, cw - x, width - cx0 - x) AS width_used, least(mh, ch - y, height - cy0 - y) AS tile_height FROM t5)"""


def _tiles(spark, sf_dir):
    return grid.tile_geometry(grid.tile_plan(_cropped(spark, sf_dir)))


@query(f"WITH {TILES} SELECT image_id, tile_seq, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("x", "y", "tile_width", "tile_height", "width_used")) + " FROM tiles WHERE width_used > 0 AND tile_height > 0")
def tile_geometry(spark, sf_dir):
    return _tiles(spark, sf_dir).select("image_id", "tile_seq", "x", "y", "tile_width", "tile_height", "width_used")


@query(f"WITH {TILES} SELECT image_id, tile_seq, CAST(CASE WHEN dma THEN tile_seq % 2 ELSE 0 END AS INTEGER) AS buffer_slot FROM tiles WHERE width_used > 0 AND tile_height > 0")
def dma_slot(spark, sf_dir):
    return _tiles(spark, sf_dir).select("image_id", "tile_seq", "buffer_slot")


@query(f"""WITH {DISPLAYS} SELECT image_id, display_w, display_h, CAST(CASE WHEN NOT (width > display_w OR height > display_h) THEN 0
 WHEN width > display_w * 4 OR height > display_h * 4 THEN 3 WHEN width > display_w * 2 OR height > display_h * 2 THEN 2 ELSE 1 END AS INTEGER) AS fit_shift,
 CAST(CASE WHEN image_id % 3 = 0 THEN 3 WHEN image_id % 2 = 0 THEN 1 WHEN image_id % 5 = 0 THEN 2 WHEN image_id % 7 = 0 THEN 3 ELSE 0 END AS INTEGER) AS option_shift FROM shown""")
def scale_choice(spark, sf_dir):
    image = F.col("image_id")
    fit = G.fit_shift(F.col("width"), F.col("height"), F.col("display_w"), F.col("display_h"))
    asked = G.scale_shift(image % 2 == 0, image % 5 == 0, image % 7 == 0, image % 3 == 0)
    return derived.displays(spark, sf_dir).select("image_id", "display_w", "display_h", fit.alias("fit_shift"), asked.alias("option_shift"))


@query(f"WITH {IMAGES}, s AS (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS shift FROM images) SELECT image_id, shift, CAST((width + (1 << shift) - 1) >> shift AS INTEGER) AS scaled_w, CAST((height + (1 << shift) - 1) >> shift AS INTEGER) AS scaled_h FROM s")
def scaled_dims(spark, sf_dir):
    rows = derived.images(spark, sf_dir).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("image_id", "shift", *[G.scaled(F.col(c), F.col("shift")).alias(f"scaled_{c[0]}") for c in ("width", "height")])


@query(f"""WITH {DISPLAYS}, a AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN req_x ELSE -2 END AS ax, CASE WHEN image_id % 3 = 0 THEN req_y ELSE -2 END AS ay FROM shown)
 SELECT image_id, CAST(CASE WHEN ax = -2 THEN greatest(0, (display_w - width) // 2) ELSE ax END AS INTEGER) AS x, CAST(CASE WHEN ay = -2 THEN greatest(0, (display_h - height) // 2) ELSE ay END AS INTEGER) AS y,
 (ax <> -2 AND (ax < 0 OR ax + width > display_w)) OR (ay <> -2 AND (ay < 0 OR ay + height > display_h)) AS rejected FROM a""")
def centre_placement(spark, sf_dir):
    rows = derived.displays(spark, sf_dir)
    ax, ay = (F.when(F.col("image_id") % 3 == 0, F.col(c)).otherwise(CENTRE) for c in ("req_x", "req_y"))
    rows = rows.withColumns({"_ax": ax, "_ay": ay})
    x, y = G.centred(F.col("_ax"), F.col("width"), F.col("display_w")), G.centred(F.col("_ay"), F.col("height"), F.col("display_h"))
    bad = G.placement_error(F.col("_ax"), F.col("width"), F.col("display_w")) | G.placement_error(F.col("_ay"), F.col("height"), F.col("display_h"))
    return rows.select("image_id", x.alias("x"), y.alias("y"), bad.alias("rejected"))


@query(f"WITH {TILES} SELECT t.image_id, tile_seq, CAST(y + tile_height AS INTEGER) AS bottom FROM tiles t JOIN supplier ON t.image_id % 10 + 1 = s_suppkey WHERE width_used > 0 AND tile_height > 0 AND y + tile_height <= 30 + s_suppkey * 11 % 160")
def bounds_exit(spark, sf_dir):
    """Tiles down to the display's bottom: a filter in place of a callback that stops."""
    heights = derived.displays(spark, sf_dir).select("image_id", "display_h")
    rows = _tiles(spark, sf_dir).join(heights, "image_id").withColumn("bottom", F.col("y") + F.col("tile_height"))
    return rows.filter("bottom <= display_h").select("image_id", "tile_seq", "bottom")


@query(f"WITH {DISPLAYS}, ys AS (SELECT *, unnest(range(0, display_h, height)) AS y FROM shown) SELECT image_id, CAST(unnest(range(0, display_w, width)) AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM ys")
def sprite_tiling(spark, sf_dir):
    return grid.sprites(derived.displays(spark, sf_dir)).select("image_id", "x", "y")


# ---- blocks


@query(f"WITH {DC} SELECT event_id, size, v, CAST(CASE WHEN size = 0 THEN 0 WHEN v < (1 << (size - 1)) THEN v - (1 << size) + 1 ELSE v END AS INTEGER) AS diff FROM (SELECT *, CAST(event_id % (1 << size) AS INTEGER) AS v FROM stream)")
def extend_bits(spark, sf_dir):
    size = F.col("size")
    rows = derived.dc_stream(spark, sf_dir).withColumn("v", (F.col("event_id") % F.call_function("shiftleft", F.lit(1), size)).cast("int"))
    return rows.select("event_id", "size", "v", P.extend_bits(F.col("v"), size).alias("diff"))


@query(f"WITH {DC} SELECT event_id, CAST(event_id % 4 AS INTEGER) AS low, CAST(dc_diff * (1 << (event_id % 4)) AS INTEGER) AS diff FROM stream")
def point_transform(spark, sf_dir):
    rows = derived.dc_stream(spark, sf_dir).withColumn("low", (F.col("event_id") % 4).cast("int"))
    return rows.select("event_id", "low", P.point_transform(F.col("dc_diff"), F.col("low")).alias("diff"))


@query(f"WITH {BLOCKS} SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, coefs[{PLACES}[i]] AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM blocks)")
def zigzag_reorder(spark, sf_dir):
    return derived.blocks(spark, sf_dir).select("vec_id", *_numbered(B.to_natural(F.col("coefs")), "value"))


@query(f"WITH {NATURAL} SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(quant[i] AS INTEGER) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM natural_blocks)")
def quant_prescale(spark, sf_dir):
    return derived.blocks(spark, sf_dir).select("vec_id", *_numbered(B.prescaled(F.col("quant")), "value"))


def _dequantized(spark, sf_dir):
    rows = derived.blocks(spark, sf_dir)
    return rows.select("vec_id", B.dequantized(B.to_natural(F.col("coefs")), B.prescaled(F.col("quant"))).alias("d"))


@query(f"WITH {NATURAL} SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(d[i] AS INTEGER) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM dequantized)")
def dequantize(spark, sf_dir):
    return _dequantized(spark, sf_dir).select("vec_id", *_numbered(F.col("d"), "value"))


@query(f"WITH {NATURAL} SELECT vec_id, CAST(i AS INTEGER) AS position, CAST({CLIP.format('d[1] >> 5')} AS INTEGER) AS sample FROM (SELECT *, unnest(range(64)) AS i FROM dequantized)")
def dc_fill(spark, sf_dir):
    rows = derived.blocks(spark, sf_dir)
    return rows.select("vec_id", *_numbered(B.dc_fill(F.element_at("coefs", 1), F.element_at(B.prescaled(F.col("quant")), 1)), "sample"))


@query(f"WITH {NATURAL} SELECT vec_id, CAST({CLIP.format('d[1] >> 5')} AS INTEGER) AS sample FROM dequantized")
def idct_eighth(spark, sf_dir):
    """One sample a block; the AC coefficients are never touched."""
    rows = derived.blocks(spark, sf_dir)
    return rows.select("vec_id", B.dc_sample(F.element_at("coefs", 1), F.element_at(B.prescaled(F.col("quant")), 1)).alias("sample"))


@query(f"""WITH {NATURAL}, s AS (SELECT vec_id, [d[1] + d[9] + d[2] + d[10], d[1] + d[9] - d[2] - d[10], d[1] - d[9] + d[2] - d[10], d[1] - d[9] - d[2] + d[10]] AS t FROM dequantized)
 SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST({CLIP.format('t[i] >> 5')} AS INTEGER) AS sample FROM (SELECT *, unnest(range(1, 5)) AS i FROM s)""")
def idct_quarter(spark, sf_dir):
    return _dequantized(spark, sf_dir).select("vec_id", *_numbered(B.idct_quarter(F.col("d")), "sample"))


def _sql_pass(source: str, to: str) -> str:
    """One 1-D pass in SQL over rows (vec_id, line, x0..x7): rows (vec_id, line, v0..v7)."""
    return f"""{to}a AS (SELECT vec_id, line, x0 + x4 AS a, x0 - x4 AS b, x2 + x6 AS c, x2 - x6 AS n, x5 + x3 AS z13, x5 - x3 AS z10, x1 + x7 AS z11, x1 - x7 AS z12 FROM {source}),
 {to}b AS (SELECT vec_id, line, a + c AS e0, a - c AS e3, b, ((n * 362) >> 8) - c AS d, z11 + z13 AS o7, ((z10 + z12) * 473) >> 8 AS z5, (z10 * -669) >> 8 AS z10, (z12 * 277) >> 8 AS z12, ((z11 - z13) * 362) >> 8 AS t5 FROM {to}a),
 {to}c AS (SELECT *, b + d AS e1, b - d AS e2, z10 + z5 - o7 AS o6 FROM {to}b), {to}d AS (SELECT *, t5 - o6 AS o5 FROM {to}c), {to}e AS (SELECT *, z12 - z5 + o5 AS o4 FROM {to}d),
 {to} AS (SELECT vec_id, line, e0 + o7 AS v0, e1 + o6 AS v1, e2 + o5 AS v2, e3 - o4 AS v3, e3 + o4 AS v4, e2 - o5 AS v5, e1 - o6 AS v6, e0 - o7 AS v7 FROM {to}e)"""


@query(
    f"WITH {NATURAL}, lines AS (SELECT vec_id, line, "
    + ", ".join(f"d[line + {8 * j + 1}] AS x{j}" for j in range(8))
    + f" FROM (SELECT *, unnest(range(8)) AS line FROM dequantized)), {_sql_pass('lines', 'p')}, mid AS (SELECT vec_id, r AS line, "
    + ", ".join(f"max(CASE WHEN line = {j} THEN ((v + 32768) & 65535) - 32768 END) AS x{j}" for j in range(8))
    + " FROM (SELECT vec_id, line, unnest([v0, v1, v2, v3, v4, v5, v6, v7]) AS v, unnest(range(8)) AS r FROM p) GROUP BY vec_id, r), "
    + _sql_pass("mid", "q")
    + f" SELECT vec_id, CAST(line * 8 + c AS INTEGER) AS position, CAST({CLIP.format('v >> 5')} AS INTEGER) AS sample FROM (SELECT vec_id, line, unnest([v0, v1, v2, v3, v4, v5, v6, v7]) AS v, unnest(range(8)) AS c FROM q)"
)
def idct_8x8(spark, sf_dir):
    return _dequantized(spark, sf_dir).select("vec_id", *_numbered(B.idct(F.col("d")), "sample"))


@query(f"""WITH {BLOCKS}, s AS (SELECT vec_id, list_transform(coefs, lambda v: CASE WHEN abs(v) < 48 THEN 0 ELSE v END) AS c FROM blocks),
 e AS (SELECT vec_id, c, unnest(range(1, 65)) AS i FROM s)
 SELECT vec_id, CAST(bit_or(CASE WHEN i > 1 AND c[i] <> 0 THEN 1 << ((i - 1) % 8) ELSE 0 END) AS INTEGER) AS column_mask, CAST(max(CASE WHEN c[i] <> 0 THEN i - 1 ELSE 0 END) AS INTEGER) AS last_place, bool_or(i > 1 AND c[i] <> 0) AS has_ac FROM e GROUP BY vec_id""")
def block_sparsity(spark, sf_dir):
    rows = derived.blocks(spark, sf_dir).select("vec_id", F.transform("coefs", lambda v: F.when(F.abs(v) < 48, 0).otherwise(v)).alias("c"))
    mask = B.column_mask(F.col("c"))
    return rows.select("vec_id", mask.alias("column_mask"), B.last_place(F.col("c")).alias("last_place"), (mask != 0).alias("has_ac"))


# ---- windows, aggregates, joins

SEGMENTED = f"{DC}, numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY event_id) - 1 AS mcu_index FROM stream), segmented AS (SELECT *, CAST(mcu_index // 40 AS INTEGER) AS segment_id FROM numbered)"


def _segmented(spark, sf_dir):
    order = Window.partitionBy("image_id").orderBy("event_id")
    rows = derived.dc_stream(spark, sf_dir).withColumn("mcu_index", F.row_number().over(order) - 1)
    return prediction.restart_segments(rows, "mcu_index", 40)


@query(f"WITH {SEGMENTED} SELECT image_id, segment_id, min(mcu_index) AS first_mcu, count(*) AS n_mcus FROM segmented GROUP BY image_id, segment_id")
def restart_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).groupBy("image_id", "segment_id").agg(F.min("mcu_index").cast("long").alias("first_mcu"), F.count("*").alias("n_mcus"))


@query(f"WITH {SEGMENTED} SELECT image_id, event_id, segment_id, CAST(sum(dc_diff) OVER (PARTITION BY image_id, segment_id ORDER BY event_id) AS BIGINT) AS dc FROM segmented")
def dc_predict_window(spark, sf_dir):
    return prediction.predict_dc(_segmented(spark, sf_dir), ["image_id", "segment_id"], ["event_id"]).select("image_id", "event_id", "segment_id", "dc")


@query(f"WITH {RASTER64} SELECT image_id, CAST(y >> 1 AS INTEGER) AS y, CAST(x >> 1 AS INTEGER) AS x, CAST((sum(lum) + 2) // 4 AS INTEGER) AS lum FROM raster GROUP BY image_id, y >> 1, x >> 1 HAVING count(*) = 4")
def half_scale_gray(spark, sf_dir):
    return resample.half_scale_gray(derived.raster(spark, sf_dir))


@query(f"""WITH {RASTER64}, quads AS (SELECT image_id, y >> 1 AS y, x >> 1 AS x, CAST(sum(lum) AS INTEGER) AS l4, CAST((sum(cb) + 2) // 4 AS INTEGER) AS cb, CAST((sum(cr) + 2) // 4 AS INTEGER) AS cr FROM raster GROUP BY image_id, raster.y >> 1, raster.x >> 1 HAVING count(*) = 4),
 rgb AS (SELECT *, {CLAMPED.format('(l4 * 1024 + 5742 * (cr - 128)) >> 12')} AS r, {CLAMPED.format('(l4 * 1024 - 1409 * (cb - 128) - 2925 * (cr - 128)) >> 12')} AS g, {CLAMPED.format('(l4 * 1024 + 7258 * (cb - 128)) >> 12')} AS b FROM quads)
 SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST({PACK} AS INTEGER) AS rgb565 FROM rgb""")
def half_scale_colour(spark, sf_dir):
    rows = resample.half_scale_colour(derived.raster(spark, sf_dir))
    return rows.select("image_id", "y", "x", P.pack565(*P.rgb_of(F.col("lum12"), F.col("cb"), F.col("cr"))).alias("rgb565"))


def _upsample_sql(dx: int, dy: int) -> str:
    return f"""WITH {RASTER64}, {RASTER.format(high=64 >> dy, wide=64 >> dx).replace('raster AS', 'chroma AS', 1)},
 joined AS (SELECT l.image_id, l.y, l.x, l.lum, coalesce(c.cb, 128) AS cb, coalesce(c.cr, 128) AS cr FROM raster l LEFT JOIN chroma c ON l.image_id = c.image_id AND l.x >> {dx} = c.x AND l.y >> {dy} = c.y),
 {RGB} FROM joined) SELECT image_id, y, x, CAST({PACK} AS INTEGER) AS rgb565 FROM rgb"""


def _upsampled(spark, sf_dir, subsample: int) -> DataFrame:
    dx, dy = resample.SHIFTS[subsample]
    luma = derived.raster(spark, sf_dir).select("image_id", "y", "x", "lum")
    rows = resample.upsample(luma, derived.raster(spark, sf_dir, 64 >> dx, 64 >> dy).drop("lum"), subsample)
    return rows.select("image_id", "y", "x", P.rgb565_le(F.col("lum"), F.col("cb"), F.col("cr")).alias("rgb565"))


@query(_upsample_sql(0, 0))
def upsample_444(spark, sf_dir):
    return _upsampled(spark, sf_dir, 0x11)


@query(_upsample_sql(1, 1))
def upsample_420(spark, sf_dir):
    return _upsampled(spark, sf_dir, 0x22)


@query(_upsample_sql(0, 1))
def upsample_8x16(spark, sf_dir):
    return _upsampled(spark, sf_dir, 0x12)


@query(_upsample_sql(1, 0))
def upsample_16x8(spark, sf_dir):
    return _upsampled(spark, sf_dir, 0x21)


@query(f"WITH {RASTER64}, n AS (SELECT *, unnest([1, 2, 4]) AS bits FROM raster) SELECT image_id, bits, y, CAST(x // (8 // bits) AS INTEGER) AS byte_index, CAST(sum((lum >> (8 - bits)) << (8 - bits - (x % (8 // bits)) * bits)) AS INTEGER) AS byte FROM n GROUP BY image_id, bits, y, x // (8 // bits)")
def pack_bits(spark, sf_dir):
    rows = derived.raster(spark, sf_dir)
    parts = [resample.pack_bits(rows.withColumn("level", P.dither_level(F.col("lum"), n)), n).withColumn("bits", F.lit(n)) for n in (1, 2, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH w AS (SELECT o_orderkey, CAST((o_orderkey * 2654435761) % 4294967296 AS BIGINT) AS v FROM orders)
 SELECT o_orderkey, CAST(v >> 16 AS INTEGER) AS be16, CAST((((v >> 16) & 255) << 8) | (v >> 24) AS INTEGER) AS le16, v AS be32,
 CAST(((v & 255) << 24) | (((v >> 8) & 255) << 16) | (((v >> 16) & 255) << 8) | (v >> 24) AS BIGINT) AS le32 FROM w""")
def tiff_words(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.hex((F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)), 8, "0").alias("h"))
    short, long = F.substring("h", 1, 4), F.col("h")
    return rows.select("o_orderkey", G.tiff_short(short, F.lit(False)).alias("be16"), G.tiff_short(short, F.lit(True)).alias("le16"), G.tiff_long(long, F.lit(False)).alias("be32"), G.tiff_long(long, F.lit(True)).alias("le32"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PROGRESSIVE' ELSE 'BASELINE' END AS jpeg_type FROM part")
def jpeg_type(spark, sf_dir):
    sof = F.when(F.col("p_partkey") % 3 == 0, 0xC2).otherwise(0xC0)
    return derived.table(spark, sf_dir, "part").select("p_partkey", G.jpeg_type(sof).alias("jpeg_type"))


# ---- encoded images: checked by round trips in the tests, since no table has image bytes


def _images(spark, sf_dir):
    from ..sources.synthetic import synthetic_images

    return synthetic_images(spark, sf_dir)


def _frames(spark, sf_dir, output: str = "frames", **options):
    from .decode import decode
    from .options import DecodeOptions

    return decode(_images(spark, sf_dir), DecodeOptions(**options), output)


def _digested(rows: DataFrame, column: str = "data") -> DataFrame:
    return rows.withColumn(f"{column}_sha256", F.sha2(column, 256)).drop(column)


@query()
def header_info(spark, sf_dir):
    info = _frames(spark, sf_dir, "info")
    return info.select("image_id", "status", "error_code", "width", "height", "bpp", "subsample", "mode", "num_components", "orientation", "has_thumb", "thumb_width", "thumb_height", "thumb_offset", "restart_interval", "scan_offset")


@query()
def image_segments(spark, sf_dir):
    """Restart intervals without byte stuffing: the parallel units of entropy decoding."""
    from ..operators.images import segments

    return segments(_images(spark, sf_dir)).select("image_id", "segment_id", "first_mcu", "n_mcus", F.length("data").alias("n_bytes"))


@query()
def entropy_blocks(spark, sf_dir):
    return _frames(spark, sf_dir, "blocks").select("image_id", "segment_id", "mcu_index", "component", "block_in_mcu", "dc_diff", F.array_join("coefs", ",").alias("coefs"))


@query()
def sample_blocks(spark, sf_dir):
    return _frames(spark, sf_dir, "samples").select("image_id", "mcu_index", "component", "block_in_mcu", F.array_join("samples", ",").alias("samples"))


@query()
def decode_full(spark, sf_dir):
    return _digested(_frames(spark, sf_dir))


@query()
def decode_rgba(spark, sf_dir):
    from .options import PixelType

    return _digested(_frames(spark, sf_dir, pixel_type=PixelType.RGB8888))


@query()
def decode_luma(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, luma_only=True))


@query()
def decode_half(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, scale=2))


@query()
def decode_quarter(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, scale=4))


@query()
def decode_eighth(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, scale=8))


@query()
def decode_cropped(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, crop=(8, 8, 20, 20)))


@query()
def decode_progressive_dc(spark, sf_dir):
    """Progressive images as one-eighth previews of their first scan."""
    from ..operators.images import decode_frames, image_info

    images = _images(spark, sf_dir)
    chosen = image_info(images).filter("mode = 'PROGRESSIVE'").select("image_id")
    return _digested(decode_frames(images.join(chosen, "image_id", "left_semi")))


@query()
def exif_thumbnail(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, thumbnail=True))


@query()
def decode_tiles(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, "tiles", dma=True), "pixels")


@query()
def frame_assemble(spark, sf_dir):
    """Frames put together from tiles, in Column expressions."""
    from ..operators.images import assemble

    return _digested(assemble(_frames(spark, sf_dir, "tiles", max_mcus=2), 2))


@query()
def bmp_bytes(spark, sf_dir):
    return _digested(_frames(spark, sf_dir, "bmp"), "bmp")


def _dithered(spark, sf_dir, bits: int):
    from ..operators.images import dither

    pixels = derived.raster(spark, sf_dir).select("image_id", "y", F.struct("x", "lum").alias("p"))
    rows = pixels.groupBy("image_id", "y").agg(F.map_from_entries(F.collect_list("p")).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: F.lpad(F.hex(F.coalesce(F.try_element_at("m", x), F.lit(0)).cast("long")), 2, "0"))
    out = dither(rows.select(F.col("image_id").cast("long").alias("image_id"), "y", F.unhex(F.array_join(line, "")).alias("gray")), bits)
    return out.select("image_id", "y", F.hex("packed").alias("packed"))


@query()
def dither_1(spark, sf_dir):
    return _dithered(spark, sf_dir, 1)


@query()
def dither_2(spark, sf_dir):
    return _dithered(spark, sf_dir, 2)


@query()
def dither_4(spark, sf_dir):
    return _dithered(spark, sf_dir, 4)


@query("""SELECT o_custkey AS file_id, CAST(sum(octet_length(encode(o_orderstatus || CAST(o_orderkey AS VARCHAR)))) AS BIGINT) AS length,
 CASE WHEN sum(octet_length(encode(o_orderstatus || CAST(o_orderkey AS VARCHAR)))) > 100 THEN 'INVALID_PARAMETER' ELSE 'SUCCESS' END AS status,
 CASE WHEN sum(octet_length(encode(o_orderstatus || CAST(o_orderkey AS VARCHAR)))) > 100 THEN NULL ELSE string_agg(o_orderstatus || CAST(o_orderkey AS VARCHAR), '' ORDER BY o_orderkey) END AS content
 FROM orders GROUP BY o_custkey""")
def upload_reassembly(spark, sf_dir):
    """Chunks of an upload (here: of a customer's orders) put together at their byte places, if they fit."""
    from ..sources.files import reassemble

    rows = derived.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.encode(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")), "utf-8").alias("chunk"))
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.withColumn("byte_index", F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)))
    out = reassemble(chunks.select(F.col("o_custkey").alias("file_id"), "byte_index", "chunk"), 100)
    return out.withColumn("content", F.decode("content", "utf-8"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FF00' WHEN 1 THEN '0FF0' WHEN 2 THEN 'FFD0' ELSE 'FFFF00' END AS mid, printf('%08X', o_orderkey % 4294967296) AS h FROM orders)
 SELECT o_orderkey, replace(upper(regexp_replace(regexp_replace(regexp_replace(h || mid || h, '(..)', '\\1 ', 'g'), 'FF 00 ', 'ff ', 'g'), 'FF (?:[0-9A-F]{2} )?', '', 'g')), ' ', '') AS clean FROM s""")
def unstuff(spark, sf_dir):
    key = F.col("o_orderkey")
    middle = F.element_at(F.array(*[F.lit(v) for v in ("FF00", "0FF0", "FFD0", "FFFF00")]), (key % 4 + 1).cast("int"))
    h = F.lpad(F.hex(key % F.lit(4294967296)), 8, "0")
    return derived.table(spark, sf_dir, "orders").select("o_orderkey", F.hex(P.unstuffed(F.unhex(F.concat(h, middle, h)))).alias("clean"))


@query("SELECT * FROM (VALUES (0, 'SUCCESS'), (1, 'INVALID_PARAMETER'), (2, 'DECODE_ERROR'), (3, 'UNSUPPORTED'), (4, 'INVALID_FILE'), (5, 'ERROR_MEMORY')) AS t(error_code, status)")
def status_names(spark, sf_dir):
    from .options import Status

    return spark.createDataFrame([(int(s), s.name) for s in Status], "error_code int, status string")


@query()
def decode_dithered(spark, sf_dir):
    from .options import PixelType

    return _digested(_frames(spark, sf_dir, pixel_type=PixelType.DITHER2))


@query()
def client_dither(spark, sf_dir):
    """Tiles of 565 pixels to four levels of their green channel, with error diffusion inside each tile."""
    from ..operators.images import client_dither as run

    return _digested(run(_frames(spark, sf_dir, "tiles")), "levels")


# ---- encoded images of flat blocks: their files are encoded and decoded here, while the twins state by arithmetic what must come out

MOSAIC = """k AS (SELECT s_suppkey AS image_id, 9 + s_suppkey * 7 % 40 AS w, 6 + s_suppkey * 11 % 30 AS h, s_suppkey % 5 AS t, s_suppkey % 4 AS restart FROM supplier),
 i AS (SELECT *, CASE WHEN t IN (3, 4) THEN 16 ELSE 8 END AS mw, CASE WHEN t IN (2, 4) THEN 16 ELSE 8 END AS mh FROM k),
 g AS (SELECT *, (w + mw - 1) // mw AS cx, (h + mh - 1) // mh AS cy FROM i),
 m AS (SELECT *, mcu % cx AS mx, mcu // cx AS my, CASE WHEN restart = 0 THEN 0 ELSE mcu // restart END AS segment FROM (SELECT *, unnest(range(cx * cy)) AS mcu FROM g)),
 b AS (SELECT *, CASE WHEN c = 0 THEN (31 * image_id + least(mx * mw // 8 + n % (mw // 8), (w - 1) // 8) * 17 + least(my * mh // 8 + n // (mw // 8), (h - 1) // 8) * 23) % 256
   ELSE (31 * image_id + 57 * c + mx * 17 + my * 23) % 256 END AS v
   FROM (SELECT *, 0 AS c, unnest(range(mw * mh // 64)) AS n FROM m UNION ALL SELECT *, unnest([1, 2]) AS c, 0 AS n FROM m WHERE t > 0))"""


def _mosaics(spark, sf_dir):
    from ..sources.synthetic import mosaic, synthetic_images

    return synthetic_images(spark, sf_dir, make=mosaic)


def _mosaic(spark, sf_dir, output: str = "frames", **options):
    from .decode import decode
    from .options import DecodeOptions

    return decode(_mosaics(spark, sf_dir), DecodeOptions(**options), output)


@query(f"""WITH {MOSAIC} SELECT image_id, 'SUCCESS' AS status, 0 AS error_code, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CASE WHEN t = 0 THEN 8 ELSE 24 END AS bpp,
 CASE t WHEN 0 THEN 0 WHEN 1 THEN 17 WHEN 2 THEN 18 WHEN 3 THEN 33 ELSE 34 END AS subsample, 'BASELINE' AS mode, CASE WHEN t = 0 THEN 1 ELSE 3 END AS num_components,
 CAST(CASE WHEN image_id % 3 = 1 THEN 1 + image_id % 8 ELSE 0 END AS INTEGER) AS orientation, false AS has_thumb, CAST(restart AS INTEGER) AS restart_interval FROM g""")
def mosaic_info(spark, sf_dir):
    names = ("image_id", "status", "error_code", "width", "height", "bpp", "subsample", "mode", "num_components", "orientation", "has_thumb", "restart_interval")
    return _mosaic(spark, sf_dir, "info").select(*names)


@query(f"""WITH {MOSAIC} SELECT image_id, CAST(segment AS INTEGER) AS segment_id, CAST(min(mcu) AS INTEGER) AS first_mcu, CAST(count(*) AS INTEGER) AS n_mcus FROM m GROUP BY image_id, segment""")
def mosaic_segments(spark, sf_dir):
    from ..operators.images import segments

    return segments(_mosaics(spark, sf_dir)).select("image_id", "segment_id", "first_mcu", "n_mcus")


@query(f"""WITH {MOSAIC} SELECT image_id, CAST(segment AS INTEGER) AS segment_id, CAST(mcu AS INTEGER) AS mcu_index, CAST(c AS INTEGER) AS component, CAST(CASE WHEN c = 0 THEN n ELSE mw * mh // 64 + c - 1 END AS INTEGER) AS block_in_mcu,
 CAST(8 * (v - coalesce(lag(v) OVER (PARTITION BY image_id, segment, c ORDER BY mcu, n), 128)) AS INTEGER) AS dc_diff, repeat(',0', 63) AS ac FROM b""")
def mosaic_blocks(spark, sf_dir):
    """Entropy-decoded blocks: differences of DC, and no AC at all."""
    ac = F.concat(F.lit(","), F.array_join(F.slice("coefs", 2, 63), ","))
    return _mosaic(spark, sf_dir, "blocks").select("image_id", "segment_id", "mcu_index", "component", "block_in_mcu", "dc_diff", ac.alias("ac"))


@query(f"""WITH {MOSAIC} SELECT image_id, CAST(mcu AS INTEGER) AS mcu_index, CAST(c AS INTEGER) AS component, CAST(CASE WHEN c = 0 THEN n ELSE mw * mh // 64 + c - 1 END AS INTEGER) AS block_in_mcu, repeat(v || ',', 64) AS samples FROM b""")
def mosaic_samples(spark, sf_dir):
    """Blocks with DC predicted over their segment, dequantized and transformed."""
    return _mosaic(spark, sf_dir, "samples").select("image_id", "mcu_index", "component", "block_in_mcu", F.concat(F.array_join("samples", ","), F.lit(",")).alias("samples"))


_LE565 = "printf('%02X%02X', ((g & 28) << 3) | (b >> 3), (r & 248) | (g >> 5))"


def _mosaic_sql(shift: int = 0, pixel: str = _LE565, kind: str = "RGB565_LE") -> str:
    """Frames in hexadecimal: the pixel at (x, y) is that of the blocks there, at any scale."""
    return f"""WITH {MOSAIC}, s AS (SELECT *, (w + {(1 << shift) - 1}) >> {shift} AS sw, (h + {(1 << shift) - 1}) >> {shift} AS sh FROM g),
 p AS (SELECT *, (31 * image_id + (x << {shift}) // 8 * 17 + (y << {shift}) // 8 * 23) % 256 AS lum,
  CASE WHEN t = 0 THEN 0 ELSE (31 * image_id + 57 + (x << {shift}) // mw * 17 + (y << {shift}) // mh * 23) % 256 - 128 END AS cb,
  CASE WHEN t = 0 THEN 0 ELSE (31 * image_id + 114 + (x << {shift}) // mw * 17 + (y << {shift}) // mh * 23) % 256 - 128 END AS cr
  FROM (SELECT *, unnest(range(sw)) AS x FROM (SELECT *, unnest(range(sh)) AS y FROM s))),
 q AS (SELECT *, CAST(greatest(0, least(255, floor((4096 * lum + 5742 * cr) / 4096.0))) AS BIGINT) AS r, CAST(greatest(0, least(255, floor((4096 * lum - 1409 * cb - 2925 * cr) / 4096.0))) AS BIGINT) AS g,
  CAST(greatest(0, least(255, floor((4096 * lum + 7258 * cb) / 4096.0))) AS BIGINT) AS b FROM p)
 SELECT image_id, 'SUCCESS' AS status, 0 AS error_code, CAST(max(sw) AS INTEGER) AS width, CAST(max(sh) AS INTEGER) AS height, '{kind}' AS pixel_type, string_agg({pixel}, '' ORDER BY y, x) AS data FROM q GROUP BY image_id"""


def _mosaic_frames(spark, sf_dir, **options):
    return _mosaic(spark, sf_dir, **options).withColumn("data", F.hex("data"))


@query(_mosaic_sql())
def mosaic_full(spark, sf_dir):
    return _mosaic_frames(spark, sf_dir)


@query(_mosaic_sql(pixel="printf('%02X%02X', (r & 248) | (g >> 5), ((g & 28) << 3) | (b >> 3))", kind="RGB565_BE"))
def mosaic_big_endian(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.RGB565_BE)


@query(_mosaic_sql(pixel="printf('%02X%02X%02XFF', r, g, b)", kind="RGB8888"))
def mosaic_rgba(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.RGB8888)


@query(_mosaic_sql(0, "printf('%02X', lum)", "GRAY8"))
def mosaic_gray_full(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.GRAY8, scale=1)


@query(_mosaic_sql(1, "printf('%02X', lum)", "GRAY8"))
def mosaic_gray_half(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.GRAY8, scale=2)


@query(_mosaic_sql(2, "printf('%02X', lum)", "GRAY8"))
def mosaic_gray_quarter(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.GRAY8, scale=4)


@query(_mosaic_sql(3, "printf('%02X', lum)", "GRAY8"))
def mosaic_gray_eighth(spark, sf_dir):
    from .options import PixelType

    return _mosaic_frames(spark, sf_dir, pixel_type=PixelType.GRAY8, scale=8)


@query(_mosaic_sql(1))
def mosaic_half(spark, sf_dir):
    return _mosaic_frames(spark, sf_dir, scale=2)


@query(_mosaic_sql(2))
def mosaic_quarter(spark, sf_dir):
    return _mosaic_frames(spark, sf_dir, scale=4)


@query(_mosaic_sql(3))
def mosaic_eighth(spark, sf_dir):
    return _mosaic_frames(spark, sf_dir, scale=8)
