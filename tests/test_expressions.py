"""Worked values and independent models of the scalar rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.codec import tables as T
from tessera.codec.decode import align_crop
from tessera.codec.header import Component, Header
from tessera.functions import blocks as B
from tessera.functions import geometry as G
from tessera.functions import pixels as P
from tessera.plans.options import DecodeOptions

CROPS = [
    ((640, 480, 0x22), (50, 50, 125, 170), (48, 48, 128, 176)),
    ((320, 240, 0x22), (120, 65, 119, 110), (112, 64, 128, 112)),
    ((640, 480, 0x22), (600, 50, 125, 170), (592, 48, 624, 176)),
]


@pytest.mark.parametrize(("image", "request_", "want"), CROPS)
def test_crop_worked_values(spark, image, request_, want):
    row = spark.range(1).select(G.align_crop(*[F.lit(v) for v in (*image, *request_)]).alias("c")).first().c
    assert tuple(row) == want
    header = Header(image[0], image[1], components=[Component(1, 0, 2, 2, 0), Component(2, 1, 1, 1, 0), Component(3, 2, 1, 1, 0)])
    assert align_crop(header, request_) == want


@pytest.mark.parametrize(("sub", "kind", "dma", "want"), [(0x22, 0, False, 8), (0x22, 2, False, 4), (0x22, 3, False, 16), (0x11, 0, False, 32), (0x22, 0, True, 4)])
def test_tile_worked_values(spark, sub, kind, dma, want):
    m = {0x22: 16, 0x11: 8}[sub]
    args = [F.lit(v) for v in (4000 // m, m, m, kind, 1000, dma, 4000, 4000)]
    assert spark.range(1).select(G.tile_mcus(*args)).first()[0] == want


def test_colour_by_numpy_model(spark):
    rows = spark.range(0, 4096).select(((F.col("id") * 37) % 256).cast("int").alias("y"), ((F.col("id") * 11) % 256).cast("int").alias("b"), ((F.col("id") * 101) % 256).cast("int").alias("r"))
    got = rows.select("y", "b", "r", P.rgb565_le("y" and F.col("y"), F.col("b"), F.col("r")).alias("p"), P.rgba8888(F.col("y"), F.col("b"), F.col("r")).alias("q")).toPandas()
    y, b, r = (got[c].to_numpy(np.int64) for c in "ybr")
    red, green, blue = (np.clip(v >> 12, 0, 255) for v in ((y << 12) + 5742 * (r - 128), (y << 12) - 1409 * (b - 128) - 2925 * (r - 128), (y << 12) + 7258 * (b - 128)))
    assert (got.p == (((red & 0xF8) << 8) | ((green & 0xFC) << 3) | (blue >> 3))).all()
    assert (got.q == red + (green << 8) + (blue << 16) + (255 << 24)).all()


def test_zigzag_is_a_permutation_and_its_inverse():
    assert sorted(B.ZIGZAG) == list(range(64)) and [B.ZIGZAG[p] for p in B.PLACE] == list(range(64))
    assert B.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2]


def test_transform_agrees_with_numpy_and_float(spark):
    draw = np.random.default_rng(1)
    blocks = (draw.normal(0, 12, (40, 64)) / (1 + np.arange(64) % 8 + np.arange(64) // 8)).astype(int)
    quant = np.full(64, 16)
    dequant = blocks * T.prescaled(quant)
    frame = spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(dequant)], "k int, d array<int>")
    got = np.array([r.s for r in frame.select("k", B.idct(F.col("d")).alias("s")).orderBy("k").collect()])
    assert (got == T.idct(dequant)).all()
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    exact = np.clip(np.rint(np.einsum("ux,nuv,vy->nxy", cos, (blocks * 16).reshape(-1, 8, 8), cos) + 128), 0, 255).reshape(-1, 64)
    assert np.abs(T.samples_of(blocks, quant, 0, precise=True) - exact).max() <= 2


def test_dc_rule(spark):
    row = spark.range(1).select(B.dc_sample(F.lit(-37), F.lit(4 * 9)).alias("v")).first()
    assert row.v == min(255, max(0, ((-37 * 9) >> 3) + 128))


@pytest.mark.parametrize("bad", [{"scale": 3}, {"max_mcus": 0}, {"idct": "other"}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError, match="is"):
        DecodeOptions(**bad)
