"""Operators on encoded images: the relational path against the fused one, sources, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.codec.decode import decode_frame
from tessera.operators import images as I  # noqa: N812
from tessera.plans.decode import decode
from tessera.plans.options import DecodeOptions, Mode, PixelType
from tessera.sources.synthetic import encoded


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(k, bytearray(encoded(k))) for k in range(1, 34)] + [(99, None)], "image_id long, content binary").cache()


def test_header_columns(some):
    rows = {r.image_id: r for r in decode(some, output="info").collect()}
    assert rows[99].status == "INVALID_FILE" and rows[31].status == "INVALID_FILE" and rows[31].width is None
    assert rows[1].status == "SUCCESS" and rows[1].subsample == 0x11 and rows[1].has_thumb and rows[1].quant[0][0] >= 1


def test_blocks_and_samples_agree_with_the_fused_path(some):
    samples = decode(some, output="samples").filter("component = 0").toPandas()
    for key, rows in samples.groupby("image_id"):
        frame = decode_frame(encoded(key), DecodeOptions(pixel_type=PixelType.GRAY8))
        if frame.shift or frame.status.name != "SUCCESS":
            continue
        mw, mh = frame.header.mcu
        plane = np.zeros((frame.header.grid[1] * mh, frame.header.grid[0] * mw), int)
        for r in rows.itertuples():
            x, y = r.mcu_x * mw + r.block_in_mcu % (mw // 8) * 8, r.mcu_y * mh + r.block_in_mcu // (mw // 8) * 8
            plane[y : y + 8, x : x + 8] = np.array(r.samples).reshape(8, 8)
        assert (plane[: frame.height, : frame.width] == frame.pixels).all(), key


def test_tiles_assemble_to_frames(some):
    frames = {r.image_id: r for r in decode(some, output="frames").filter("width > 0").collect()}
    built = {r.image_id: r for r in I.assemble(decode(some, DecodeOptions(max_mcus=2), "tiles"), 2).collect()}
    assert frames.keys() == built.keys()
    for key, frame in frames.items():
        assert (built[key].width, built[key].height, bytes(built[key].data)) == (frame.width, frame.height, bytes(frame.data))


def test_modes(some):
    assert decode(some).count() == 34
    kept = decode(some, DecodeOptions(mode=Mode.DROPMALFORMED))
    assert kept.filter("error_code <> 0").isEmpty() and kept.count() < 34
    with pytest.raises(Exception, match="INVALID_FILE|DECODE_ERROR"):
        decode(some, DecodeOptions(mode=Mode.FAILFAST)).collect()
    alternate = decode(some, DecodeOptions(dma=True, max_mcus=1), "tiles").select("tile_seq", "buffer_slot").distinct().collect()
    assert all(r.buffer_slot == r.tile_seq % 2 for r in alternate)


def test_plans_prune(spark, sf_dir):
    from tessera.plans.queries import QUERIES

    plan = QUERIES["luma_only"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan and "l_suppkey" not in plan


def test_files_streams_and_bitmaps(spark, some, tmp_path):
    from tessera.sources.files import read_images, reassemble, register
    from tessera.streaming.ingest import stream_frames, write_frames

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(1, 5):
        (folder / f"a{k}.{'JPG' if k % 2 else 'jpeg'}").write_bytes(encoded(k))
    (folder / "b.txt").write_bytes(b"no")
    found = read_images(spark, str(folder))
    assert found.count() == 4
    assert "length" in found.filter("length > 256")._jdf.queryExecution().executedPlan().toString()
    write_frames(stream_frames(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (folder / "c.jpg").write_bytes(encoded(6))
    write_frames(stream_frames(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    register(spark)
    files = decode(some.filter("image_id < 5"), output="bmp")
    files.write.format("bmp").mode("append").save(str(tmp_path / "bmp"))
    assert sorted(p.name for p in (tmp_path / "bmp").iterdir()) == [f"{k}.bmp" for k in range(1, 5)]
    data = encoded(3)
    chunks = [(1, at, bytearray(data[at : at + 100])) for at in range(0, len(data), 100)] + [(2, 0, bytearray(b"x" * 50)), (2, 60, bytearray(b"y"))]
    back = {r.file_id: r for r in reassemble(spark.createDataFrame(chunks, "file_id long, byte_index long, chunk binary"), 100_000).collect()}
    assert bytes(back[1].content) == data and back[2].status == "DECODE_ERROR"
    assert reassemble(spark.createDataFrame(chunks, "file_id long, byte_index long, chunk binary"), 10).filter(F.col("content").isNotNull()).isEmpty()


class Caught:
    """Stands for a DataFrame and for a reader, to get the function that workers would run."""

    def __init__(self, spark):
        self.sparkSession, self.sparkContext, self.read = spark, spark.sparkContext, self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run

    mapInArrow = mapInPandas  # noqa: N815

    def parquet(self, *a):
        return self

    select = repartition = parquet


def test_images_are_made_piece_by_piece(spark):
    """A worker that is given 10,000 keys at once hands on the first images before it makes the last."""
    import pandas as pd

    from tessera.sources.synthetic import synthetic_images

    asked = []
    frames = synthetic_images(Caught(spark), "", make=lambda k: asked.append(k) or b"x")([pd.DataFrame({"image_id": range(10_000)})])
    first = next(frames)
    assert len(first) == len(asked) <= 256
    assert [*first["image_id"], *(k for f in frames for k in f["image_id"])] == [*range(10_000)] == asked


def test_results_are_handed_on_by_bytes_as_well_as_by_rows(spark):
    import pyarrow as pa

    asked = []
    run = I._mapped(Caught(spark), lambda item: asked.append(item.image_id) or [(item.image_id, b"x" * 300_000)], "image_id long, data binary")
    batches = run([pa.RecordBatch.from_pydict({"image_id": [*range(100)]})])
    first = next(batches)
    assert first.num_rows == len(asked) <= 8
    assert [*first.column(0).to_pylist(), *(k for b in batches for k in b.column(0).to_pylist())] == [*range(100)] == asked
