import re

import pytest
from helpers import canonical
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as X
from tessera.llm.queries import ORACLES, op1_exact_dedup


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for doc, text in rows:
        own = groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")]
        known = [d for d in own if d is not None]
        out.append((doc, min(known) if known else None, len(own)))
    return sorted(out, key=repr)


def test_query_same_as_duckdb(spark, sf_dir, duck):
    assert canonical(op1_exact_dedup(spark, sf_dir).toPandas()) == canonical(duck.sql(ORACLES["op1_exact_dedup"]).df())


@pytest.mark.parametrize("digest", [X.sha256, lambda text: F.unhex(F.lit("00"))])
def test_odd_rows_and_colliding_digests(odd, digest):
    """With a digest that never tells texts apart, content still does."""
    rows = odd.select("doc_id", "text").collect()
    got = X.assign(odd, digest=digest, salts=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute([(r.doc_id, r.text) for r in rows])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_deduplicate_keeps_columns_and_one_of_each(odd, empty):
    out = X.deduplicate(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 5, 6]
    assert X.deduplicate(empty).isEmpty() and X.assign(empty).isEmpty()


def test_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    out = X.assign(rows).filter("group_size > 1")
    assert out.count() == 2000 and out.filter("kept").count() == 1
