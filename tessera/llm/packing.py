"""Packing of token ids into windows, best fit decreasing.

A document that is longer than a window is first cut into full windows and a rest. Pieces go, longest first, into the
open window with the least room that still holds them; a segment tree over remaining capacities finds it in
log(window) steps. Best fit decreasing works on groups of pieces: the pieces are dealt into groups of about
``group_pieces`` by a hash, each group is packed by one task, and prefix sums over the groups number the sequences.
The number of groups follows from the bytes of the texts, so tokens are dealt as they are made.
A group's size doesn't depend on the input's, so tasks stay as small at any scale, and a few thousand pieces are
enough for a last-window loss far below one per cent.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow, cut, in_slices, text_of, utf8
from .pieces import PRE_TOKEN_BYTES, pieces

#: Pieces in a group, on average; groups whose first sequence numbers are broadcast (16 bytes each), at most.
GROUP_PIECES, MOST_BASES = 8192, 500_000


class CapacityTree:
    """Open windows by remaining capacity, 0 to ``top``: a segment tree of counts over the capacities."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at, count = capacity + self.leaves, self.count
        while at:
            count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``least``, taken out; None if there is none."""
        at, count = least + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # a right child, or nothing in its right sibling
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset in it) of each length; lengths must descend. Window numbers are gapless from 0."""
    tree, used, places, offsets = CapacityTree(window), 0, [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, used = (window, used), used + 1
        capacity, number = found
        places.append(number)
        offsets.append(window - capacity)
        if capacity > n:
            tree.put(capacity - n, number)
    return places, offsets


def cut_into_pieces(df: DataFrame, tokenizer_path: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remember: int = PRE_TOKEN_BYTES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids``: full windows of a document and its rest."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, end = pieces(tokenizer_path, 4, remember), end_id.to_bytes(4, "little")
        width = 4
        for batch in in_slices(batches):
            row, starts, sizes, crcs, totals, ids = [], [], [], [], [], []
            for k, text in enumerate(utf8(batch.column(1))):
                found = known.ids(text) + end
                total = len(found) // width
                for start in range(0, total, window):
                    part = found[start * width : (start + window) * width]
                    row.append(k)
                    starts.append(start)
                    sizes.append(len(part) // width)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                bounds = np.cumsum([0, *sizes]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), "<i4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, keep=(tokenizer_path, 4, remember))


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False, remember: int = PRE_TOKEN_BYTES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens`` (and ``ids``).

    ``start``: ids of its document before the piece; ``offset``: its place in its sequence. Sequences are numbered from
    0 without gaps and hold ``sequence_tokens`` ids, at most ``window``. Null and empty texts are documents of the end
    id alone. Null ids, and rows that repeat one, are packed like any others; pieces of one length go by id, then by their
    place and checksum. An empty table gives no rows. Other columns are not read. ``remember``: bytes of pre-tokens that a worker remembers.
    """
    # Texts have a token per 2 bytes at most, nearly always; where they have more, groups are twice as large at most.
    size = df.select((1 + F.octet_length(text_of(F.col(text_col).cast("string"))) / (2 * window)).cast("long").alias("n")).agg(F.sum("n")).first()[0]
    groups = max(1, -(-(size or 0) // group_pieces))
    found = cut_into_pieces(df, tokenizer_path, end_id, window, id_col, text_col, with_ids, remember)
    dealt = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(groups)))

    def place(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        sequence, offset = (np.array(x, np.int64) for x in best_fit_decreasing(lengths.tolist(), window))
        total = np.bincount(sequence, lengths).astype(np.int64)[sequence]
        for name, values in (("sequence", sequence), ("offset", offset), ("sequence_tokens", total)):
            table = table.append_column(name, pa.array(values))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence long, offset long, sequence_tokens long"
    ship(df.sparkSession)
    packed = cut(dealt.groupBy("_group").applyInArrow(place, schema))
    sizes = packed.groupBy("_group").agg((F.max("sequence") + 1).alias("_n"))
    bases = prefix_sums(cut(sizes), "_group", "_n").select(F.col("_group").alias("_of"), "_base")
    # One row of two numbers per group: beyond MOST_BASES groups they are shuffled.
    out = packed.join(F.broadcast(bases) if groups <= MOST_BASES else bases, F.col("_group") == F.col("_of"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("sequence")).alias("sequence_id"), "offset", "sequence_tokens", *["ids"] * with_ids)


def prefix_sums(sizes: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """``sizes`` (one row per key, numbered from 0) with _base, the sum of ``n`` over all smaller keys.

    Sums within blocks of keys, then over the blocks: the one task that sees all blocks has a row per ``block`` keys.
    """
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_block", F.floor(F.col(key) / block))
    blocks = rows.groupBy("_block").agg(F.sum(n).alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_block"))), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_within", F.coalesce(F.sum(n).over(before(Window.partitionBy("_block").orderBy(key))), F.lit(0)))
    return rows.join(blocks, "_block").withColumn("_base", F.col("_before") + F.col("_within"))
