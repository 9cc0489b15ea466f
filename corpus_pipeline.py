"""A training corpus from raw documents: toxicity, exact copies, near copies, benchmark passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result as Parquet in the shared folder and reads it again as the next one's input, so a lost executor never
reaches back over more than one stage. All but the last return the columns of documents. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from tessera.llm.common import new_folder
from tessera.llm.pieces import vocabulary_path

TOKENIZER, END_ID, WINDOW_TOKENS = "byte_bpe_50k.json", 1, 2048
#: Bytes of pre-tokens that a worker of packing remembers: few, beside what earlier stages left in their executors' memory.
REMEMBERED = 24 << 20
#: Words and hundredths of similarity of the near-duplicate stage.
SHINGLE, THRESHOLD = 5, (80, 100)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0.

    Null and empty texts score what no sentence explains, as all do without labels; null ids teach nothing. Rows that
    repeat stay or go together.
    """
    model = toxicity.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), _table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the document of the smallest id; rows that repeat it whole stay with it."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of the smallest id; documents without words or without an id stay."""
    return near_dedup.deduplicate(docs, shingle=SHINGLE, threshold=THRESHOLD)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of their documents; a document that is mostly benchmark goes.

    Null and empty texts, and all where the benchmark is empty, stay as they are.
    """
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids; null and empty texts are the end id alone."""
    return packing.pack(docs, vocabulary_path(TOKENIZER), END_ID, WINDOW_TOKENS, with_ids=True, remember=REMEMBERED)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]

#: SQL can't express a fitted model, MinHash components or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), new_folder(spark, "corpus-pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
