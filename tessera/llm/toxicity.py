"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only bags have labels. A sentence's log-odds z are a bias and the sum of its words'
weights, a word's weight being that of the word and its stems. It is toxic with probability sigmoid(z), and the document
with 1 - prod(1 - sigmoid(z)), a noisy-or, which equals 1 - exp(-sum softplus(z)); a leak stands for labels that no
sentence explains. Only sentences with a known feature take part: the rest are certain not to offend, so length alone
raises no score. The weights follow from the documents' labels by gradient descent on that likelihood, and afterwards
tell the offending sentences within a document.

Fitting uses a bounded sample of the labelled rows (``sample`` documents, picked by a hash of their id, so it is the same
on every run and for every size of cluster), of any length. The driver gets ``sample`` x MEAN_SAMPLE bytes of text at
most: where the picked ones have more, or one has more than MOST_SAMPLE, the longest give a sample of their sentences.
Scoring reads every row and whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow, cut, in_slices, release, utf8

#: Labelled documents a model is fitted on, at most; bytes of their texts, at most: on average, and of one.
SAMPLE, MEAN_SAMPLE, MOST_SAMPLE = 5000, 20_000, 1_000_000
#: Lengths in bytes of the word beginnings that are features.
STEMS = (3, 4, 5, 6)
#: A feature that a model knows is in so many different sampled sentences, and tells their labels by so much chi-square.
LEAST_SENTENCES, LEAST_CHI = 4, 25.0
#: ... and the share of label 1 among its sentences lies so far from the overall share to 1.
LEAST_LIFT = 0.25

_SENTENCE = re.compile(rb"[.!?\n\r]+")
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalpha() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    leak: float


def sentences(text: bytes) -> list[bytes]:
    return _SENTENCE.split(text)


def words_of(sentence: bytes) -> list[bytes]:
    return sentence.translate(_TO_WORDS).split()


def allowance(sizes: list[int], total: int) -> int:
    """The most bytes that each text may give so that all give ``total`` at most; MOST_SAMPLE if that is less."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return min(share, MOST_SAMPLE)
        left -= size
    return MOST_SAMPLE


def shortened(text: bytes, most: int) -> bytes:
    """Sentences of the text, picked by their hashes, of ``most`` bytes at most with their ends; the text's own beginning if none fits."""
    import xxhash

    if len(text) <= most:
        return text
    parts = [s for s in sentences(text) if s.strip()]
    kept, size = [], 0
    for at in sorted(range(len(parts)), key=lambda k: (xxhash.xxh3_64_intdigest(parts[k]), k)):
        if size + len(parts[at]) + 1 <= most:
            kept.append(at)
            size += len(parts[at]) + 1
    return b"\n".join(parts[at] for at in sorted(kept)) or text[:most].decode(errors="ignore").encode()


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id_col: str, sample: int) -> list[tuple[int, bytes]]:
    """(id, label, text) of at most ``sample`` labelled documents; an id's labels that disagree leave it out, of its texts the smallest counts."""
    known = labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").drop("_other")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    picked = rows.select("_doc", F.octet_length("_text").alias("_bytes")).join(known, F.col("_doc") == F.col("_id")).select("_id", "_label", "_bytes").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = cut(picked)
    most = allowance([r._bytes for r in picked.select("_bytes").collect()], sample * MEAN_SAMPLE)
    # At most ``sample`` rows: a broadcast of proven size.
    found = rows.join(F.broadcast(picked.select("_id", "_label").distinct()), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text")

    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches):
            texts = [shortened(text, most).decode() for text in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_label", "_text"])

    found = arrow(found, run, found.schema).groupBy("_id").agg(F.min(F.struct("_label", "_text")).alias("_s")).select("_id", "_s.*")
    return sorted((r._id, r._label, r._text.encode()) for r in found.toLocalIterator())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the documents that have a label.

    Null texts and labels, null ids and ids whose labels disagree are left out; of the texts that share an id, the smallest
    counts; ties of the sampling hash go by id. Without labels of both kinds, as in an empty table, every score is about
    the share of label 1. Other columns are not read.
    """
    model = fit([(label, text) for _, label, text in sample_of(docs, labels, id_col, text_col, label_col, label_id_col, sample)])
    release()
    return model


def features(word: bytes) -> list[bytes]:
    """The word and its beginnings: inflected and made-up forms of an insult share a stem."""
    return [word, *(b"^" + word[:k] for k in STEMS if len(word) > k)]


def bag_of(text: bytes) -> list[frozenset[bytes]]:
    """The words of each sentence that has any."""
    return [frozenset(w) for s in sentences(text) if (w := words_of(s))]


def telling_features(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """Features whose sentences lie in documents of label 1 more than chance has it (by chi-square and by share).

    Equal sentences count once, so that copies of a document are no evidence of their own. Texts are split anew in each
    pass, and sentences are told apart by a hash: the driver never holds the words of all texts at once.
    """
    label_of: dict[int, int] = {}
    for y, text in rows:
        for s in bag_of(text):
            label_of[hash(s)] = min(label_of.get(hash(s), 1), y)
    total, positive = len(label_of), sum(label_of.values())
    if not 0 < positive < total:
        return []
    seen: dict[bytes, int] = {}
    hot: dict[bytes, int] = {}
    for _, text in rows:
        for s in bag_of(text):
            y = label_of.pop(hash(s), None)
            if y is None:
                continue
            for f in {f for word in s for f in features(word)}:
                seen[f] = seen.get(f, 0) + 1
                if y:
                    hot[f] = hot.get(f, 0) + 1
    rate, found = positive / total, []
    for f, n in seen.items():
        if n >= LEAST_SENTENCES and hot.get(f, 0) >= n * (rate + LEAST_LIFT * (1 - rate)):
            chi = (hot.get(f, 0) - n * rate) ** 2 / (n * rate * (1 - rate) * (1 - n / (total + 1)))
            if chi >= LEAST_CHI:
                found.append((-chi, f))
    return [f for _, f in sorted(found)]


def fit(rows: list[tuple[int, bytes]], epochs: int = 60, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Likelihood of a leaky noisy-or by Adam over mini-batches of documents, in a fixed order.

    The leak is one more term of each document; it takes up labels that no sentence explains, which would otherwise
    raise the bias and with it the score of every long document.
    """
    import numpy as np

    known = telling_features(rows)
    if not known:
        share = sum(y for y, _ in rows) / len(rows) if rows else 0.0
        return Model({}, -30.0, -np.log1p(-min(max(share, 1e-6), 1 - 1e-6)))
    number = {w: k for k, w in enumerate(known)}
    labels = np.array([y for y, _ in rows], float)
    # Flat arrays: the known words of all sentences, each with its sentence; each sentence with its document.
    word, word_at, doc_at = [], [], []
    for d, (_, text) in enumerate(rows):
        for s in bag_of(text):
            own = [number[f] for w in s for f in features(w) if f in number]
            if own:
                word.extend(own)
                word_at.extend([len(doc_at)] * len(own))
                doc_at.append(d)
    word, word_at, doc_at = (np.array(x, np.int64) for x in (word, word_at, doc_at))
    first_s = np.searchsorted(doc_at, np.arange(len(rows) + 1))
    first_w = np.searchsorted(word_at, np.arange(len(doc_at) + 1))
    # The parameters: a weight for each word, the sentences' bias, the documents' leak.
    at = np.concatenate((np.zeros(len(known)), [-6.0, -3.0]))
    m1, m2, step = np.zeros_like(at), np.zeros_like(at), 0
    draw = np.random.default_rng(7)
    for epoch in range(epochs):
        for batch in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 250)):
            n_s = first_s[batch + 1] - first_s[batch]
            s_doc = np.repeat(np.arange(len(batch)), n_s)
            s_at = np.repeat(first_s[batch] - (np.cumsum(n_s) - n_s), n_s) + np.arange(n_s.sum())
            n_w = first_w[s_at + 1] - first_w[s_at]
            w_at = np.repeat(first_w[s_at] - (np.cumsum(n_w) - n_w), n_w) + np.arange(n_w.sum())
            own, own_s = word[w_at], np.repeat(np.arange(len(s_at)), n_w)
            z = at[-2] + np.bincount(own_s, at[own], len(s_at))
            total = np.bincount(s_doc, np.logaddexp(0, z), len(batch)) + np.logaddexp(0, at[-1])
            # The derivative of the loss by the total: 1 for label 0, -exp(-S) / (1 - exp(-S)) for label 1.
            pull = np.where(labels[batch] > 0.5, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
            s_pull = pull[s_doc] / (1 + np.exp(-np.clip(z, -50, 50)))
            g = np.concatenate((np.bincount(own, s_pull[own_s], len(known)), [s_pull.sum(), pull.sum() / (1 + np.exp(-at[-1]))])) / len(batch)
            g[:-2] += decay * at[:-2]
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            at -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model({w: float(x) for w, x in zip(known, at, strict=False)}, float(at[-2]), float(np.logaddexp(0, at[-1])))


def place_of(text: bytes, sentence: int) -> tuple[int, int]:
    """Where sentences(text)[sentence] begins and ends, in bytes."""
    start = 0
    for at, end in enumerate(_SENTENCE.finditer(text)):
        if at == sentence:
            return start, end.start()
        start = end.end()
    return start, len(text)


class Scorer:
    def __init__(self, model: Model):
        get = model.weights.get
        self.weight, self.bias, self.leak = Memo(lambda word: sum(get(f, 0.0) for f in features(word))), model.bias, model.leak

    def bag(self, text: bytes) -> tuple[float, int | None, float]:
        """The document's probability, the number of its worst sentence (the first of equals) and that one's probability."""
        from math import exp, expm1, log1p

        weight, bias, total, worst, worst_z = self.weight, self.bias, self.leak, None, None
        for at, s in enumerate(sentences(text)):
            if words := words_of(s):
                told = sum(map(weight.__getitem__, {*words}))
                if told:
                    z = bias + told
                    total += z if z > 30 else log1p(exp(z))
                    if worst_z is None or z > worst_z:
                        worst, worst_z = at, z
        return -expm1(-total), worst, 0.0 if worst_z is None else 1 / (1 + exp(-max(-50.0, min(50.0, worst_z))))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: ``doc_id, score, worst_start, worst_end, worst_score``.

    ``worst_start`` and ``worst_end`` are the code points of the sentence most to blame (0, 0 where none is). Null, empty
    and wordless texts score the leak alone. Whole texts are read; rows that repeat are scored alike; a null id
    is carried. An empty table gives no rows. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(broadcast.value)
        for batch in in_slices(batches):
            scores, starts, ends, tops = [], [], [], []
            for text in utf8(batch.column(1)):
                p, worst, top = scorer.bag(text)
                start, end = (0, 0) if worst is None else place_of(text, worst)
                scores.append(p)
                starts.append(len(text[:start].decode()))
                ends.append(starts[-1] + len(text[start:end].decode()))
                tops.append(top)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(tops, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, score double, worst_start long, worst_end long, worst_score double")


def clean(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """df without the documents that score ``threshold`` or more; all columns stay, and texts pass through once.

    Null, empty and wordless texts score the leak alone. Rows that repeat stay or go together, null ids make no difference,
    and an empty table stays empty.
    """
    names = df.columns
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    at = names.index(text_col)
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(broadcast.value)
        for batch in in_slices(batches):
            yield batch.filter(pa.array([scorer.bag(text)[0] < threshold for text in utf8(batch.column(at))], pa.bool_()))

    return arrow(inner, run, inner.schema).toDF(*names)
