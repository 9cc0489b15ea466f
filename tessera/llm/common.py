"""What the operators of this subpackage share: the shared folder, lineage cuts, hot-key joins, Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Keys joined by broadcast in join_skewed(): the broadcast side never has more rows than this.
HOT_KEYS = 1000
#: Bytes of an Arrow batch that goes to Python, about.
BATCH_BYTES = 8 << 20
#: Bytes of what a worker remembers of single words, about, and the longest word that it remembers.
MEMO_BYTES, LONGEST_WORD = 24 << 20, 64
#: Bytes of rows that a task of cut_to_few() reads, about.
PART_BYTES = 8 << 20

_HELD: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests, one machine), a temporary folder of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its plan starts anew from reliable files.

    Spark cleans the shuffles, broadcasts and checkpoints that the driver's garbage collector finds unused, so it is asked
    to look for them here, as it would else only do when its heap is full.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return out


def cut_to_few(df: DataFrame) -> DataFrame:
    """cut(), read again in as few partitions as its bytes need, but in two for each core.

    Only partitions as they are read become one; how a shuffle deals its rows stays. The driver keeps a few KB for each
    task, so small tables that many steps read again shouldn't have a task for each of many small partitions.
    """
    out = cut(df)
    rdd = out._jdf.queryExecution().logical().rdd()
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    conf = df.sparkSession._jsc.hadoopConfiguration()
    size = path.getFileSystem(conf).getContentSummary(path).getLength()
    few = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return out.coalesce(few) if few < rdd.getNumPartitions() else out


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, cols: Sequence[str], spread: Column) -> DataFrame:
    """Left outer join with ``right`` (one row per key; ``weight``: how many left rows have that key).

    The at most HOT_KEYS heaviest keys are joined by broadcast. Rows that they serve go through the shuffle join
    under a second key taken from ``spread``, so that no task gathers the rows of a heavy key.
    """
    top = right.orderBy(F.desc(weight), F.asc(key)).limit(HOT_KEYS).select(F.col(key).alias("_hot_key"), F.struct(*cols).alias("_hot"))
    lhs = left.join(F.broadcast(top), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    lhs = lhs.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(F.lit(0).cast("long")))
    rhs = right.select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_spread"), F.struct(*cols).alias("_cold"))
    out = lhs.join(rhs, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in cols])


class Memo(dict):
    """Word -> what ``make`` gives for it; forgets all beyond ``size`` bytes, and never keeps words beyond LONGEST_WORD."""

    def __init__(self, make, size: int = MEMO_BYTES):
        self.make, self.size, self.room = make, size, size

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= LONGEST_WORD:
            # An entry's objects and its place in the table take some 200 bytes beside what they hold.
            self.room -= 200 + len(word) + (len(value) if isinstance(value, bytes) else 0)
            if self.room < 0:
                self.clear()
                self.room = self.size
            self[word] = value
        return value


def held(key, make):
    """The one thing that a worker keeps from task to task: made anew unless it was made for the same key."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Memory that a worker has freed goes back to the system, for idle workers stay."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(function, batches: Iterable, keep) -> Iterable:
    """What ``function`` yields; a worker that holds another thing than ``keep`` drops it before."""
    if keep not in _HELD:
        _HELD.clear()
    try:
        yield from function(batches)
    finally:
        release()


def arrow(df: DataFrame, function, schema, keep=None) -> DataFrame:
    """mapInArrow with this package on the executors, and with batches of few bytes, for texts may be long.

    ``keep``: the key of what the function takes from held(). The session's limit on a batch's bytes is lowered to
    BATCH_BYTES, if it is above.
    """
    spark = df.sparkSession
    ship(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit, "64m")) > BATCH_BYTES:
        spark.conf.set(limit, f"{BATCH_BYTES}b")

    def run(batches):
        return tidied(function, batches, keep)

    return df.mapInArrow(run, schema)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def in_slices(batches: Iterable, rows: int = 512) -> Iterable:
    """Arrow batches in slices of few rows, so that Python holds the objects of few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_CUT = re.compile(rb"(?<=[\x21-\x7E])[\x20\x09-\x0D]")


def stretches(text: bytes, size: int = 1 << 20) -> Iterable[bytes]:
    """A text in parts of about ``size`` bytes, each of which ends with printable ASCII before ASCII white space.

    So no word, and no white space that a tokenizer could join, is cut, and Python holds the words of one part at a time.
    """
    at = 0
    while len(text) - at > size and (end := _CUT.search(text, at + size)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text
