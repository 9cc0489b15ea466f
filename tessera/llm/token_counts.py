"""Token counts without token ids.

In each task: a document's pre-tokens become frequencies; the pieces of a pre-token are counted by the library once and
remembered; the two are joined by pre-token and summed. The join stays inside the task: sending the (document,
pre-token, frequency) rows through a shuffle would move several times the input to save a few microseconds a distinct
pre-token, so no row is shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, in_slices, utf8
from .pieces import PRE_TOKEN_BYTES, pieces


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: ``doc_id, n_bytes, n_tokens``.

    Null and empty text: 0 bytes, 0 tokens. Texts are read whole at any length; strings of special tokens inside a text
    count as the tokenizer has them by default. Rows that repeat are counted each; a null id is carried. Other columns
    are not read. The file must be at ``tokenizer_path`` on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known = pieces(tokenizer_path)
        for batch in in_slices(batches):
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(known.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long", keep=(tokenizer_path, 4, PRE_TOKEN_BYTES))
