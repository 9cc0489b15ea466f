"""Every query with a DuckDB twin gives the same rows; the others give rows."""

import pytest
from helpers import canonical

from tessera.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


#: Queries of natural pictures; what they return is checked by the round trips of test_codec.py and test_images.py.
PICTURES = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", PICTURES)
def test_pictures_give_one_result_each(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    every = {r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    ids = set(rows.image_id)
    assert len(rows) and not rows.duplicated(KEYS.get(name, ["image_id"])).any()
    if name.startswith(("decode_", "exif")) and name not in ("decode_tiles", "decode_progressive_dc") or name == "header_info":
        assert ids == every  # broken files have their status
        assert ((rows.status == "SUCCESS") == (rows.error_code == 0)).all()
    elif not name.startswith("dither_"):
        assert ids <= every
    for digest in (c for c in rows.columns if c.endswith("_sha256")):
        assert rows[digest].str.fullmatch("[0-9a-f]{64}").all()


BLOCK = ["image_id", "mcu_index", "component", "block_in_mcu"]
KEYS = {"image_segments": ["image_id", "segment_id"], "entropy_blocks": BLOCK, "sample_blocks": BLOCK, "decode_tiles": ["image_id", "tile_seq"], "client_dither": ["image_id", "tile_seq"]}
KEYS |= {f"dither_{bits}": ["image_id", "y"] for bits in (1, 2, 4)}


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
