"""Language and toxicity: exact code lengths, held-out accuracy, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm import toxicity as X
from tessera.llm.queries import op2_language_id, op8_toxicity

MID = "/root/testdata/sf0.01"


def plain_tables(texts, order):
    tables = {}
    for text in texts:
        s = b" " * order + text
        for i in range(order, len(s)):
            for k in range(order + 1):
                own = tables.setdefault(s[i - k : i], {})
                own[s[i]] = own.get(s[i], 0) + 1
    return tables


def plain_bits(tables, text, order):
    """Code length of a whole text by the plain definition."""
    s, bits = b" " * order + text, 0.0
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            seen = tables.get(s[i - k : i])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


TAUGHT = {"a": [b"the cat then sat\n\nthe end", b"then"], "b": ["été chat".encode(), "\U0001f600 un chat".encode() * 3]}
TOLD = [b"the cats", "é".encode(), b"", b"zzz the\tend " * 7, b"t", "chat été the".encode()]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_code_lengths_are_exact(monkeypatch, chunk):
    """Whole texts, contexts that reach over white space, and parts of any size."""
    monkeypatch.setattr(L, "chunks", lambda texts, size=chunk, of=L.chunks: of(texts, size))
    got = L.Predictor(L.build(TAUGHT)).code_lengths(TOLD) / L.ONE
    tables = [plain_tables(TAUGHT[x], L.ORDER) for x in "ab"]
    want = [[plain_bits(t, text, L.ORDER) for t in tables] for text in TOLD]
    assert np.allclose(got, want, atol=1e-5 * max(map(len, TOLD)))


def test_query_against_the_plain_definition(spark, sf_dir):
    """Every row of the table, with a model of the same sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")).collect()
    taught = {}
    for r in rows:
        if not r.held_out and r.lang is not None and (r.text or "").strip(" \t\n\v\f\r"):
            taught.setdefault(r.lang, []).append(r.text.encode()[: L.LONGEST_SAMPLE])
    assert all(len(x) <= L.SAMPLE for x in taught.values())
    tables = {x: plain_tables(own, L.ORDER) for x, own in taught.items()}
    got = {r.doc_id: r for r in op2_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = got[r.doc_id]
        assert own.held_out == r.held_out
        if not any(c.isalpha() for c in r.text or ""):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        bits = {x: plain_bits(t, r.text.encode(), L.ORDER) for x, t in tables.items()}
        best = min(sorted(bits), key=bits.get)
        assert own.lang_pred == best and abs(own.score - 1 / sum(2.0 ** max(-1000, bits[best] - x) for x in bits.values())) < 1e-2


def test_language_of_odd_rows(spark, odd, empty):
    model = L.build({"en": [b"one two one word word word"], "fr": [b"un deux un"]})
    rows = {(r.doc_id, r.lang_pred) for r in L.predict(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (None, "en"), (6, "en")} <= rows
    assert L.predict(odd, model).filter("score < 0 or score > 1 or score is null").isEmpty() and L.predict(odd, model).count() == odd.count()
    assert L.predict(empty, model).isEmpty()
    none = L.train(empty)
    assert none.languages == [] and {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"}
    assert L.train(odd).languages == ["de", "en", "fr"]  # long documents teach too


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("ab cd").alias("text"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("lang"))
    # Every byte of the sample is one key's count.
    assert [int(n.sum()) for _, n in L.train(docs, sample=50).seen] == [50 * 5] * 2
    monkeypatch.setattr(L, "MOST_SAMPLE", 2 * 200 * 7)
    assert [int(n.sum()) for _, n in L.train(docs).seen] == [7 * 5] * 2


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    out = op2_language_id(spark, MID).join(docs, "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97


def test_languages_of_long_documents_and_many_languages(spark, tmp_path):
    rows = [(k, "one two three", "en") for k in range(30)] + [(k, "zwei drei vier " * 2000, "de") for k in range(30, 60)] + [(k, "zwei drei", None) for k in range(60, 70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.lang_pred for r in op2_language_id(spark, str(tmp_path)).collect()}
    assert all(out[k] == ("en" if k < 30 else "de") for k in range(70))
    many = spark.createDataFrame([(k, f"word{k}", f"l{k}") for k in range(205)], "doc_id long, text string, lang string")
    assert len(L.train(many).languages) == 205


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    out = op8_toxicity(spark, MID).join(labels, "doc_id").filter("held_out").toPandas()
    hot, cold = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    assert (hot[:, None] > cold[None, :]).mean() > 0.8
    assert out.predicted.isin([0, 1]).all() and (cold >= 0.5).mean() < 0.05


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(5)
    plain = [f"{a}{b}or" for a in "bcdfghjk" for b in "aeiou"]
    rows = []
    for k in range(400):
        sentences = [" ".join(draw.choice(plain, 6)) for _ in range(4)]
        if k % 4 == 0:
            sentences[k % 3] += " awfulness" if k % 8 else " awful"
        rows.append((int(k % 4 == 0), ". ".join(sentences).encode()))
    return X.fit(rows)


def test_offending_sentence_is_found(spark, model):
    text = "é w1 w2. All is awfully bad here. w3 w4."
    row = X.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.score > 0.5 and "awfully" in text[row.worst_start : row.worst_end] and "w3" not in text[row.worst_start : row.worst_end]
    clean = spark.createDataFrame([(1, "w1 w2 w3. " * 3000)], "doc_id long, text string")
    assert X.score(clean, model).first().score < 0.5  # length alone is no offence


def test_toxicity_learns_from_long_documents(spark, monkeypatch):
    draw = np.random.default_rng(8)
    plain = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiou" for c in "lmnr"]
    texts = []
    for k in range(60):
        own = [" ".join(draw.choice(plain, 6)) for _ in range(900 if k % 3 < 2 else 5)]
        if k % 3 == 0:
            own[::30] = [f"{s} awfulness" for s in own[::30]]
        texts.append(". ".join(own))
    assert all(len(t) > 20_000 for t in texts[::3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    assert [t for _, _, t in X.sample_of(docs, labels, "doc_id", "text", "toxic", "doc_id", 60)] == [t.encode() for t in texts]
    assert b"awfulness" in X.train(docs, labels).weights
    monkeypatch.setattr(X, "MEAN_SAMPLE", 5000)
    rows = X.sample_of(docs, labels, "doc_id", "text", "toxic", "doc_id", 60)
    assert len(rows) == 60 and sum(len(t) for _, _, t in rows) <= 60 * 5000
    assert b"awfulness" in X.train(docs, labels, sample=60).weights


def test_toxicity_allowance():
    assert X.allowance([], 10) == X.allowance([3, 4], 10) == X.MOST_SAMPLE
    assert X.allowance([2, 50, 60], 42) == 20
    assert X.shortened("é".encode() * 10, 5) == "éé".encode()
    assert X.shortened(b"one. two. three. four", 11).count(b"\n") >= 1 and len(X.shortened(b"one. two. three. four", 11)) <= 11


def test_toxicity_of_odd_rows(spark, odd, empty, model):
    out = X.score(odd, model)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").isEmpty()
    assert X.score(empty, model).isEmpty() and X.clean(odd, model).columns == odd.columns
    assert X.clean(odd, model).count() == odd.count()
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    nothing = X.train(odd, labels)
    assert X.score(odd, nothing).select(F.max("score")).first()[0] < 0.5
    assert X.train(empty, labels.limit(0)).weights == {}


def plain_loss(model, rows):
    """Mean negative log-likelihood of the leaky noisy-or, by the plain definition."""
    total = 0.0
    for y, text in rows:
        clear = math.exp(-model.leak)
        for s in X.bag_of(text):
            own = [model.weights[f] for w in s for f in X.features(w) if f in model.weights]
            if own:
                clear *= 1 - 1 / (1 + math.exp(-(model.bias + sum(own))))
        total -= math.log(max(1e-12, 1 - clear if y else clear))
    return total / len(rows)


def bags(n=300):
    draw = np.random.default_rng(11)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for k in range(n):
        own = [" ".join(draw.choice(plain, 5)) for _ in range(3)]
        if k % 3 == 0:
            own[k % 2] += " " + ("vile" if k % 2 else "foul") + " thing"
        rows.append((int(k % 3 == 0), ". ".join(own).encode()))
    return rows


def test_scores_equal_the_plain_noisy_or(model):
    scorer = X.Scorer(model)
    for _, text in bags(60):
        clear, own = math.exp(-model.leak), []
        for s in X.bag_of(text):
            told = sum(model.weights.get(f, 0.0) for w in s for f in X.features(w))
            if told:
                own.append(1 / (1 + math.exp(-(model.bias + told))))
                clear *= 1 - own[-1]
        p, _, top = scorer.bag(text)
        assert abs(p - (1 - clear)) < 1e-9 and abs(top - max(own, default=0.0)) < 1e-9


def test_fit_is_a_minimum_of_the_plain_loss():
    """No parameter can be moved to lower the loss much: the gradient by differences is small, and a null model is worse."""
    rows = bags()
    model = X.fit(rows, epochs=120, decay=0.0)
    best = plain_loss(model, rows)
    assert best < 0.1 * plain_loss(X.Model({}, -30.0, math.log(1.5)), rows)
    for f in sorted(model.weights, key=lambda f: -abs(model.weights[f]))[:6]:
        for step in (0.05, -0.05):
            moved = X.Model(model.weights | {f: model.weights[f] + step}, model.bias, model.leak)
            assert plain_loss(moved, rows) > best - 2e-3


def test_places_of_sentences(spark):
    model = X.Model({b"awful": 9.0}, -6.0, 0.01)
    text = "fine and awfully day. awful é! awful.\n"
    row = X.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert text[row.worst_start : row.worst_end] == " awful é"
    for k, own in enumerate(X.sentences(raw := b"a.b!! c\n.d")):
        start, end = X.place_of(raw, k)
        assert raw[start:end] == own


def test_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "c"), (None, "d")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert X.sample_of(docs, labels, "doc_id", "text", "toxic", "doc_id", 9) == [(1, 1, b"a"), (2, 0, b"c")]
