"""Every stage against a plain version of itself, on the result of the one before."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from tessera.llm.queries import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "toxicity":
            assert 0.8 < docs.count() / before.count() < 1
        if name == "exact_dedup":
            norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
            want = before.groupBy(norm.alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in want.collect())
        if name == "near_dedup":
            from test_near_dedup import brute

            want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()], P.SHINGLE, P.THRESHOLD)}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "decontamination":
            from test_decontamination import brute as hits

            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, docs))
            for doc, text in old.items():
                n, hit, _, _ = hits(text, items)
                assert (doc in new) == (hit <= 0.5 * n)
                assert doc not in new or (new[doc] == text if not hit else not hits(new[doc], items)[1])
        if name != "packing":
            assert docs.columns == columns
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == sizes[-2] and docs.agg(F.max("sequence_tokens")).first()[0] <= 2048


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == [*range(1, 11)]
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_near_copies_of_a_large_family(spark, sf_dir):
    from test_near_dedup import brute, family

    rows = family(300, 5)
    want = {c for _, _, c in brute(rows, P.SHINGLE, P.THRESHOLD)}
    assert len(want) < 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in P.without_near_copies(spark, docs, sf_dir).collect()} == want


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, empty, tmp_path):
    """Nulls, blanks, repeats and clashing names pass each stage; so does nothing at all."""
    odd = odd.withColumn("n_chars", F.length("text"))
    for docs, folder in ((odd, "odd"), (empty.withColumn("n_chars", F.lit(0)), "empty")):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / folder / name))
            out = spark.read.parquet(str(tmp_path / folder / name))
            if folder == "empty":
                assert out.isEmpty()
            elif name != "packing":
                assert out.count() > 0 and (name != "exact_dedup" or {r.doc_id for r in out.collect()} == {0, 2, 3, 5, 6})
            else:
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            docs = out


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).isEmpty()
