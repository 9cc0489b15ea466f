"""Language identification by partial matching (PPM).

For each language a tree of byte contexts, of order 0 to ORDER, with frozen counts. A byte's code length follows method
C: at the longest context that the language knows, a byte seen there c times of n costs -log2(c / (n + q)), q being the
number of different bytes seen there; a byte not seen there costs the escape -log2(q / (n + q)) and goes on to the
context one byte shorter, and below order 0 every byte costs 8 bits. A text is coded whole, as if ORDER spaces stood
before it; its code length is the sum over its bytes, and the language with the shortest one is predicted.

Under frozen statistics a byte's cost depends on it and the ORDER bytes before it alone. So a batch's bytes become such
keys, a sort gathers equal ones, and each distinct key is costed once a language, with array operations. Costs are whole
numbers of 1 / ONE bit: sums are exact, whatever the batches.

Statistics come from a bounded sample of the labelled rows: ``sample`` documents of each language, picked by a hash of
their id, and the first LONGEST_SAMPLE bytes of each; MOST_SAMPLE bytes over all languages, which then share them.
Prediction reads every row and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, held, in_slices, utf8

ORDER = 4
#: Documents of a language, at most, what of each is read, in bytes, and the bytes over all languages.
SAMPLE, LONGEST_SAMPLE, MOST_SAMPLE = 500, 20_000, 64 << 20
#: Where many languages share MOST_SAMPLE, less than this is not read of a document, but fewer documents.
LEAST_SAMPLE = 200
#: Bytes that are costed together, about.
CHUNK = 2 << 20
#: A bit, in the unit of costs.
ONE = 1 << 16

UNKNOWN = "und"
_PAD = b" " * ORDER


@dataclass
class Model:
    """For each language its keys (ORDER bytes and the byte after them, as numbers, ascending) and how often each was seen."""

    languages: list[str]
    seen: list


def keys_of(parts: list[tuple[bytes, bytes]]):
    """Keys of all bytes of the parts, each of which has ORDER bytes before it, and the number of each byte's part."""
    import numpy as np

    flat = np.frombuffer(b"".join(x for part in parts for x in part), np.uint8)
    lengths = np.array([len(own) for _, own in parts], np.int64)
    part = np.repeat(np.arange(len(parts)), lengths)
    at = np.arange(len(part)) + ORDER * (part + 1)
    key = np.zeros(len(at), np.uint64)
    for k in range(ORDER, -1, -1):
        key = (key << np.uint64(8)) | flat[at - k]
    return key, part


def chunks(texts: Iterable[bytes], size: int = CHUNK):
    """Lists of (number of the text, the ORDER bytes before the part, the part) of ``size`` bytes at most."""
    out, room = [], size
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + room]
            out.append((k, (_PAD + text[max(0, at - ORDER) : at])[-ORDER:], part))
            at += len(part)
            room -= len(part)
            if not room:
                yield out
                out, room = [], size
    if out:
        yield out


def build(texts: dict[str, Iterable[bytes]]) -> Model:
    """A model from each language's texts."""
    import numpy as np

    languages, seen = sorted(texts), []
    for language in languages:
        keys, counts = np.array([], np.uint64), np.array([], np.int64)
        for parts in chunks(texts[language]):
            own, n = np.unique(keys_of([part[1:] for part in parts])[0], return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        seen.append((keys, counts))
    return Model(languages, seen)


def _found(table, keys):
    """Places of the keys in an ascending table, and which of them are there."""
    import numpy as np

    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Tree:
    """One language's contexts: by order, sorted keys of contexts with their escapes, and of context + byte with costs."""

    def __init__(self, keys, counts):
        import numpy as np

        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            symbols, inverse = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(inverse, counts, len(symbols))
            contexts, parent = np.unique(symbols >> np.uint64(8), return_inverse=True)
            total, different = np.bincount(parent, n, len(contexts)), np.bincount(parent, minlength=len(contexts))
            cost, escape = -np.log2(n / (total + different)[parent]), -np.log2(different / (total + different))
            self.levels.append((mask, symbols, np.rint(cost * ONE).astype(np.int32), contexts, np.rint(escape * ONE).astype(np.int32)))

    def costs(self, keys):
        """What the last byte of each key costs after the bytes before it."""
        import numpy as np

        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for mask, symbols, cost, contexts, escape in reversed(self.levels):
            own = keys[left] & mask
            at, there = _found(symbols, own)
            out[left[there]] += cost[at[there]]
            left, own = left[~there], own[~there]
            if not len(left):
                return out
            at, there = _found(contexts, own >> np.uint64(8))
            out[left[there]] += escape[at[there]]
        out[left] += 8 * ONE
        return out


class Predictor:
    def __init__(self, model: Model):
        self.languages, self.trees = model.languages, [Tree(*x) for x in model.seen]

    def code_lengths(self, texts: list[bytes]):
        """In units of 1 / ONE bit: an array, texts x languages."""
        import numpy as np

        out = np.zeros((len(texts), len(self.trees)))
        for parts in chunks(texts):
            key, part = keys_of([x[1:] for x in parts])
            # Key and part in one number of 64 bits: a chunk has fewer than 2 ** 24 parts, for each has a byte.
            both = np.sort((key << np.uint64(24)) | part.astype(np.uint64))
            del key, part
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
            times = np.diff(np.append(first, len(both)))
            both = both[first]
            owner = (both & np.uint64((1 << 24) - 1)).astype(np.int64)
            both >>= np.uint64(24)
            fresh = np.concatenate(([True], both[1:] != both[:-1]))
            keys, number = both[fresh], np.cumsum(fresh) - 1
            texts_of = np.array([k for k, _, _ in parts], np.int64)
            for x, tree in enumerate(self.trees):
                out[:, x] += np.bincount(texts_of, np.bincount(owner, tree.costs(keys)[number] * times, len(parts)), len(texts))
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        import numpy as np
        import regex

        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        ascii_letter, letter, out = re.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}"), []
        for text, bits in zip(texts, self.code_lengths(texts) / ONE, strict=True):
            if not ascii_letter.search(text) and not letter.search(text.decode()):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(bits.argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum())))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows with a language, every one of which gets into it. The driver gets the sample, of MOST_SAMPLE bytes.

    Rows without an id or language, or whose text is null, empty or blank, teach nothing. Ties of the hash go by id, then
    by a hash of the text, so rows that repeat may be picked together. An empty table gives a model without languages.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return build({})
    share = MOST_SAMPLE // len(sizes)
    longest = max(LEAST_SAMPLE, min(LONGEST_SAMPLE, share // sample))
    sample = max(1, min(sample, share // longest))
    # Four times as many as wanted pass by their hash alone, whatever the size, and are then ranked.
    limits = docs.sparkSession.createDataFrame([(x, 4.0 * sample / n) for x, n in sizes.items()], "_of string, _limit double")
    draw = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53))
    drawn = rows.withColumn("_draw", draw).join(F.broadcast(limits), F.col("_lang") == F.col("_of")).filter((F.col("_draw") < F.col("_limit")) | (F.col("_limit") >= 1))
    drawn = drawn.select("_id", "_lang", "_draw", F.substring("_text", 1, longest).alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_id", F.xxhash64("_text")))
    texts: dict[str, list[bytes]] = {x: [] for x in sizes}
    for r in drawn.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("_lang", "_text").toLocalIterator():
        texts[r["_lang"]].append(r["_text"].encode()[:longest])
    return build({x: own for x, own in texts.items() if own})


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: ``doc_id, lang_pred, score``; score is the posterior for equally likely languages.

    A null text, or one without letters, is ``und`` with score 0, and so is every text for a model without languages; of
    languages that tie, the first by name is taken. Rows that repeat are predicted alike; a null id is carried. An empty
    table gives no rows. Columns other than the two named are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    key = "language", broadcast._jbroadcast.id() if broadcast._jbroadcast else 0

    def run(batches):
        import pyarrow as pa

        predictor = held(key, lambda: Predictor(broadcast.value))
        for batch in in_slices(batches):
            found = predictor.predict(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, lang_pred string, score double", keep=key)
