"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items make one automaton. A document's words stream through it; after each word the automaton
knows the longest match that ends there. Where that is a window or more long, the last ``window`` words are a window of
some item, and the state says of which items; items shorter than a window count as a whole. The hit words make spans:
those of ``min_span`` words or more are removed, and a document of which more than ``max_coverage`` is hit is dropped.

The automaton is the only thing that is broadcast. Its size is bounded: items are read one by one and make blocks of at
most ``block_words`` words, one automaton each (items longer than that continue in the next block, with the overlap that
keeps every window whole), and documents pass the blocks one after another, their spans gathering on the row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, in_slices, stretches, utf8

WINDOW = 10
#: Words in one automaton, at most (about 250 bytes a word in a worker).
BLOCK_WORDS = 200_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A-Z to lower case, all other ASCII that isn't a letter or digit to a space.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Of (item, words) pairs. ``hits`` tells which words of a text lie in an occurrence of an item's window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in items:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: state -> items whose window of exactly ``window`` words ends there; state -> (length, item) of short items.
        self.windows: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        self.least = window
        for item, ids in items:
            if len(ids) < window:
                at = 0
                for w in ids:
                    at = self.next[at][w]
                short.setdefault(at, set()).add((len(ids), item))
                self.least = min(self.least, len(ids))
            else:
                for _, at in self._ends(ids, 0, len(ids)):
                    self.windows.setdefault(at, set()).add(item)
        #: state -> short items that are suffixes of its longest string, through its suffix links.
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        if short:
            for at in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if own := short.get(at, set()) | set(self.short.get(self.link[at], ())):
                    self.short[at] = tuple(sorted(own))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _ends(self, ids, start: int, end: int):
        """(position after, state of the last ``window`` words) wherever those are in an item."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at = matched = 0
        for k in range(start, end):
            w = ids[k]
            while at and w not in nxt[at]:
                at = link[at]
                matched = length[at]
            at = nxt[at].get(w, 0)
            matched = matched + 1 if at else 0
            if matched >= window:
                while length[link[at]] >= window:
                    at = link[at]
                    matched = length[at]
                yield k + 1, at

    def _short_ends(self, ids, start: int, end: int):
        nxt, link, length = self.next, self.link, self.length
        at = matched = 0
        for k in range(start, end):
            w = ids[k]
            while at and w not in nxt[at]:
                at = link[at]
                matched = length[at]
            at = nxt[at].get(w, 0)
            matched = matched + 1 if at else 0
            for n, item in self.short.get(at, ()):
                if n > matched:
                    break
                yield k + 1, n, item

    def numbers(self, text: bytes):
        """The words of a text as an array of numbers; -1: in no item."""
        import numpy as np

        get = self.vocabulary.get
        return np.concatenate([np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)) for words in map(words_of, stretches(text))])

    def hits(self, ids) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, word after the last), merged and ascending, and the items that occur, of a text's numbers."""
        import numpy as np

        if len(ids) < self.least:
            return [], set()
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least  # only runs of known words can hold a match
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            run = ids[start:end].tolist()
            if end - start >= self.window:
                for k, at in self._ends(run, 0, len(run)):
                    if at in self.windows:
                        found.append((start + k - self.window, start + k))
                        items |= self.windows[at]
            if self.short:
                for k, n, item in self._short_ends(run, 0, len(run)):
                    found.append((start + k - n, start + k))
                    items.add(item)
        return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Automata of at most ``block_words`` words each, over all items; at least one."""
    block, size, made = [], 0, 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of((row.text or "").encode())
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + block_words]
            if block and size + len(part) > block_words:
                yield SuffixAutomaton(block, window)
                block, size, made = [], 0, made + 1
            block.append((row.item if row.item is not None else "", part))
            size += len(part)
    if block or not made:
        yield SuffixAutomaton(block, window)


def _scan(df: DataFrame, automaton, carry: list[str], then=None, then_schema=None) -> DataFrame:
    """``carry`` and the columns __n_words, __spans (word numbers: start, end, start, ...), __items; adds to those that df has.

    ``then``, if given, maps these batches to ones of ``then_schema`` in the same worker.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(automaton)
    text_at, again = df.columns.index("__text"), "__spans" in df.columns
    kept = [c for c in carry if c in df.columns]
    at = [df.columns.index(c) for c in kept]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", __n_words long, __spans array<int>, __items array<string>"
    spans_at, items_at = (df.columns.index("__spans"), df.columns.index("__items")) if again else (0, 0)

    def run(batches):
        import pyarrow as pa

        known = broadcast.value
        for batch in in_slices(batches):
            sizes, all_spans, all_items = [], [], []
            before = zip(batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist(), strict=True) if again else repeat(((), ()))
            for text, (old_spans, old_items) in zip(utf8(batch.column(text_at)), before, strict=False):
                ids = known.numbers(text)
                spans, items = known.hits(ids)
                if old_spans:
                    spans = merged([*spans, *zip(old_spans[::2], old_spans[1::2], strict=True)])
                sizes.append(len(ids))
                all_spans.append([x for span in spans for x in span])
                all_items.append(sorted({*items, *old_items}))
            made = [pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + made, [*kept, "__n_words", "__spans", "__items"])

    if then is None:
        return arrow(df, run, schema)
    return arrow(df, lambda batches: then(run(batches)), then_schema)


def _scanned(df: DataFrame, benchmark: DataFrame, carry: list[str], item_col: str, item_text_col: str, window: int, block_words: int, then=None, then_schema=None) -> DataFrame:
    before = None
    for automaton in automata(benchmark, item_col, item_text_col, window, block_words):
        if before is not None:
            df = cut(_scan(df, before, [*df.columns[: df.columns.index("__text") + 1]]))
        before = automaton
    return _scan(df, before, carry, then, then_schema)


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of df: ``doc_id, n_words, n_hit, spans`` (word numbers: start, end, start, ...) and ``items``, sorted.

    Null and empty texts have no words, and items without words never occur. Ids may repeat or be null: each row has its
    own result; of items of one id, any counts. Empty tables: no rows, or no hits. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    out = _scanned(docs, benchmark, ["doc_id"], item_col, item_text_col, window, block_words)
    signed = F.transform("__spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def without_spans(text: bytes, spans: list[int], n_words: int, min_span: int, max_coverage: float) -> bytes | None:
    """text without the words of its spans of ``min_span`` words or more; None if more than ``max_coverage`` of its words are hit."""
    pairs = [*zip(spans[::2], spans[1::2], strict=True)]
    if sum(b - a for a, b in pairs) > max_coverage * n_words:
        return None
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in pairs:
        if b - a >= min_span:
            out.append(text[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join(out) + text[at:]


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with the spans removed from its texts and without the documents that are mostly hit; all columns stay.

    ``min_span`` is the shortest span, in words, that is removed (1: whatever is hit); ``length_col``, if given, becomes
    the new text's length in characters where the text changed. Texts without hits are untouched, null and empty ones
    too. Rows that repeat are treated alike, and ids play no part. An empty table stays empty; empty items change nothing.
    """
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    length = f"c{names.index(length_col)}" if length_col in names else None
    columns = inner.columns

    def without(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            spans = batch.column(len(columns) + 1).to_pylist()
            if not any(spans):
                yield batch.select(columns)
                continue
            texts, sizes = batch.column(columns.index(text)).to_pylist(), batch.column(len(columns)).to_pylist()
            keep, fresh = [True] * len(texts), {}
            for k, own in enumerate(spans):
                if own:
                    left = without_spans(texts[k].encode(), own, sizes[k], min_span, max_coverage)
                    keep[k] = left is not None
                    fresh[k] = (left or b"").decode()
            arrays = [batch.column(i) for i in range(len(columns))]
            at = columns.index(text)
            arrays[at] = pa.array([fresh.get(k, t) for k, t in enumerate(texts)], arrays[at].type)
            if length:
                at = columns.index(length)
                old = arrays[at].to_pylist()
                arrays[at] = pa.array([len(fresh[k]) if k in fresh else n for k, n in enumerate(old)], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep)) if not pc.all(pa.array(keep)).as_py() else pa.RecordBatch.from_arrays(arrays, columns)

    marked = inner.withColumn("__text", F.col(text).cast("string"))
    return _scanned(marked, benchmark, columns, item_col, item_text_col, window, block_words, without, inner.schema).toDF(*names)
