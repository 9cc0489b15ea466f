"""Token ids as flat files, for memory-mapped readers.

A folder holds, for each partition of the documents in ascending id order, three flat little-endian files:

* ``part-<number>-<attempt>.ids``: token ids, unsigned 16-bit where the vocabulary allows it, else 32-bit;
* ``part-<number>-<attempt>.off``: 64-bit offsets of its documents, in ids from the file's start, and the end;
* ``part-<number>-<attempt>.doc``: 64-bit document ids;

and ``manifest.json``: the width, the files of each partition, and each partition's base, i.e. how many ids all
partitions before it have (a prefix sum over partitions). A document's place in the corpus is base + offset.

A task names its files by its attempt, and only those of the attempt whose row reached the driver are in the manifest:
tasks that are lost, repeated or run twice leave nothing behind that a reader can meet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow, in_slices, utf8
from .pieces import PRE_TOKEN_BYTES, id_width, pieces

#: What stands for a null document id in a .doc file.
NULL_ID = -(1 << 63)


def _at(folder: str):
    """File system and path; whatever has a scheme that pyarrow knows, or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> dict:
    """Encode every whole text, append ``end_id`` to each document, write the files; returns the manifest.

    Null and empty texts have just the end id. Documents are in ascending id order, null ids first, rows that repeat an
    id in the order of their texts. An empty table gives a manifest without ids. Other columns are not read. The driver
    gets one row per file.
    """
    width = id_width(tokenizer_path, end_id)
    by = ([partitions] if partitions else []) + ["doc_id"]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(*by).sortWithinPartitions("doc_id", "text")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name, known, end = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", pieces(tokenizer_path, width), end_id.to_bytes(width, "little")
        store, path = _at(folder)
        offsets, ids = [0], []
        with store.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in in_slices(batches):
                for text in utf8(batch.column(1)):
                    found = known.ids(text)
                    out.write(found)
                    out.write(end)
                    offsets.append(offsets[-1] + len(found) // width + 1)
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
        for kind, values in (("off", np.array(offsets, "<i8")), ("doc", np.concatenate([*ids, np.array([], "<i8")]))):
            with store.open_output_stream(f"{path}/{name}.{kind}") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "docs": len(offsets) - 1, "ids": offsets[-1]}])

    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    parts = sorted(arrow(docs, write, "part long, name string, docs long, ids long", keep=(tokenizer_path, width, PRE_TOKEN_BYTES)).collect())
    bases = [0, *accumulate(p.ids for p in parts)]
    manifest = {"width": width, "n_docs": sum(p.docs for p in parts), "n_ids": bases[-1], "parts": [{"name": p.name, "docs": p.docs, "ids": p.ids, "base": b} for p, b in zip(parts, bases[:-1], strict=True)]}
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    store, path = _at(folder)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def documents_of(folder: str, part: dict, width: int) -> Iterator[tuple]:
    """(document id or None, place in the corpus, ids as an array) of one partition; local files are memory-mapped."""
    import numpy as np
    from pyarrow import fs

    store, path = _at(folder)

    def load(kind: str, dtype: str):
        name = f"{path}/{part['name']}.{kind}"
        if not store.get_file_info(name).size:
            return np.array([], dtype)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(name, dtype, "r")
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)

    ids, offsets, docs = load("ids", f"<u{width}"), load("off", "<i8"), load("doc", "<i8")
    for k, doc in enumerate(docs.tolist()):
        yield None if doc == NULL_ID else doc, part["base"] + int(offsets[k]), ids[offsets[k] : offsets[k + 1]]


def read_token_files(spark: SparkSession, folder: str, of: Callable | None = None, columns: str = "ids array<int>") -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``of`` gives for a document's ids: a tuple for ``columns``; by default the ids.

    One task per file.
    """
    manifest = read_manifest(folder)
    width, parts, of = manifest["width"], manifest["parts"], of or (lambda ids: (ids.tolist(),))

    def read(frames):
        import pandas as pd

        for frame in frames:
            for part in frame["id"]:
                rows = []
                for doc, start, ids in documents_of(folder, parts[part], width):
                    rows.append((doc, start, len(ids), *of(ids)))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = f"doc_id long, start long, n_tokens long, {columns}"
    out = spark.range(0, len(parts), 1, max(1, len(parts)))
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    ship(spark)
    return out.mapInPandas(read, schema)
