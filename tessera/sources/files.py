"""Image files: any file system that Spark reads, in batches or as a stream; chunked uploads; bitmap files as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: File names of images, in any case.
SUFFIX_GLOB = "*.[jJ][pP]{[gG],[eE][gG]}"


def _rows(files: DataFrame) -> DataFrame:
    return files.select(F.xxhash64("path").alias("image_id"), "path", F.col("modificationTime").alias("modification_time"), "length", "content")


def read_images(spark: SparkSession, path: str, recursive: bool = True, glob: str = SUFFIX_GLOB) -> DataFrame:
    """``image_id, path, modification_time, length, content``. Filters on length and time reach the scan; content is only read if it is used."""
    return _rows(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path))


def stream_images(spark: SparkSession, path: str, glob: str = SUFFIX_GLOB, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows as a stream of files that arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return _rows(reader.load(path))


def reassemble(chunks: DataFrame, most_bytes: int) -> DataFrame:
    """Uploads from (file_id, byte_index, chunk) rows: ``file_id, length, status, content``; too large ones have no content.

    Chunks that repeat are taken once. A gap makes a file a decode error.
    """
    parts = chunks.groupBy("file_id", "byte_index").agg(F.max("chunk").alias("chunk"))
    length = F.max(F.col("byte_index") + F.length("chunk"))
    files = parts.groupBy("file_id").agg(length.alias("length"), F.sum(F.length("chunk")).alias("_have"), F.array_sort(F.collect_list(F.struct("byte_index", F.when(F.col("byte_index") <= most_bytes, F.hex("chunk")).alias("hex")))).alias("_parts"))
    status = F.when(F.col("length") > most_bytes, "INVALID_PARAMETER").when(F.col("_have") != F.col("length"), "DECODE_ERROR").otherwise("SUCCESS")
    whole = F.unhex(F.array_join(F.transform("_parts", lambda p: p["hex"]), ""))
    return files.withColumn("status", status).select("file_id", "length", "status", F.when(F.col("status") == "SUCCESS", whole).alias("content"))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class BmpWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        attempt, names = TaskContext.get().taskAttemptId(), []
        for row in rows:
            name = f"{path}/{row.image_id}.bmp"
            with store.open_output_stream(f"{name}.{attempt}") as out:
                out.write(bytes(row.bmp))
            store.move(f"{name}.{attempt}", name)
            names.append(name)
        return _Written(names)

    def commit(self, messages):
        pass

    def abort(self, messages):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.names if message else []:
                store.delete_file(name)


class BmpDataSource(DataSource):
    """``df.write.format("bmp").save(folder)`` for rows (image_id, bmp): a file for each image."""

    @classmethod
    def name(cls) -> str:
        return "bmp"

    def schema(self) -> str:
        return "image_id long, bmp binary"

    def writer(self, schema, overwrite: bool) -> BmpWriter:
        return BmpWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(BmpDataSource)
