"""Counts, files and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts, token_files
from tessera.llm.common import stretches
from tessera.llm.packing import CapacityTree, best_fit_decreasing
from tessera.llm.pieces import Pieces, vocabulary_path
from tessera.llm.queries import op4_token_files, op7_packing, op9_token_counts

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


KNOWN = {p: (Pieces(p, 4), Tokenizer.from_file(p)) for p in (WORD, BYTE)}
TEXTS = st.text(st.one_of(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　'sStTreRE.,<|endoftext|>09éÉßΣσςİı́̀क्षi\U0001f600")), st.characters(exclude_categories=["Cs"])), max_size=60)


WORDS = st.lists(st.tuples(st.sampled_from([" ", " ", "  ", "\n", "\t", "\n\n", "", "\xa0 "]), st.text(st.sampled_from(list("abTHEingéÉßªµÿñ̌")), min_size=0, max_size=8), st.sampled_from(["", "", ".", ",", "!!", "|", "'s", "?)", "12", ".,"])), max_size=12).map(lambda x: "".join(map("".join, x)))


@settings(max_examples=600, deadline=None)
@given(st.one_of(TEXTS, WORDS))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_are_the_librarys(path, text):
    own, library = KNOWN[path]
    want = ids_of(library, text)
    assert np.frombuffer(own.ids(text.encode()), np.uint32).tolist() == want
    assert own.count(text.encode()) == len(want)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_texts_are_read_in_parts(path):
    """Of any size of part: what the library gives for the whole."""
    text = "It's  a \n\n long\xa0 text,\t of 12 words — and\u2003 more. " * 40
    want = ids_of(KNOWN[path][1], text)
    for size in (1, 7, 100):
        parts = [*stretches(text.encode(), size)]
        assert b"".join(parts) == text.encode() and len(parts) > 10
        got = b"".join(map(KNOWN[path][0].ids, parts))
        assert np.frombuffer(got, np.uint32).tolist() == want


def test_counts(odd, empty, word):
    got = sorted(token_counts.count_tokens(odd, WORD).collect(), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(word, r.text))) for r in odd.collect()), key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert token_counts.count_tokens(empty, WORD).isEmpty()


def test_count_query(spark, sf_dir, word):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(ids_of(word, docs[r.doc_id])) and r.over_limit == (r.n_tokens > 2048)


def test_files_query(spark, sf_dir, word):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    for r in op4_token_files(spark, sf_dir).orderBy("doc_id").collect():
        ids = [*ids_of(word, docs[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_of_odd_rows(spark, odd, empty, word, tmp_path):
    manifest = token_files.write_token_files(odd, f"file://{tmp_path}/t", WORD, 1, partitions=3)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 4, 5, 6] and manifest["width"] == 2
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(list(r.ids) == [*ids_of(word, texts[r.doc_id]), 1] for r in rows)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    none = token_files.write_token_files(empty, f"file://{tmp_path}/e", WORD, 1)
    assert none["n_ids"] == 0 and token_files.read_token_files(spark, f"file://{tmp_path}/e").isEmpty()


def check_packing(rows, texts, tokenizer, window):
    """Every id once, at most a window in a sequence, offsets without gaps."""
    for doc in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        ids = np.array([*ids_of(tokenizer, texts[doc]), 1], "<u4")
        copies = sum(1 for r in own if r.start == 0)
        assert sum(r.length for r in own) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences))) and max(sequences.values()) <= window
    return sum(sequences.values()) / (window * len(sequences))


def test_packing_query(spark, sf_dir, byte):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(op7_packing(spark, sf_dir).collect(), docs, byte, 2048) > 0.97


def test_packing_of_odd_rows(odd, empty, byte):
    texts = {r.doc_id: r.text for r in odd.collect()}
    check_packing(packing.pack(odd, BYTE, window=64, group_pieces=50).collect(), texts, byte, 64)
    with_ids = packing.pack(odd, BYTE, window=64, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    assert packing.pack(empty, BYTE).isEmpty()


def test_packing_keeps_large_and_null_ids(spark, byte):
    big = 1 << 60
    ids = [big + 1, big + 3, None, None, big + 3, (1 << 53) + 1]
    rows = [(doc, f"text {k} " * (k * 30)) for k, doc in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(df, BYTE, window=64, group_pieces=3).collect()
    assert {r.doc_id for r in out} == set(ids)
    own = {}
    for r in out:
        own.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sorted(own, key=repr) == sorted(((doc, len(byte.encode(text, add_special_tokens=False).ids) + 1) for doc, text in rows), key=repr)
    for (_, total), spans in own.items():
        assert sum(n for _, n in spans) == total and [a for a, _ in sorted(spans)] == [*range(0, total, 64)]
    assert {r.sequence_id for r in out} == set(range(1 + max(r.sequence_id for r in out)))


def test_prefix_sums(spark):
    sizes = spark.range(0, 50, 3).select(F.col("id").alias("k"), (F.col("id") % 5).alias("n"))
    out = {r.k: r._base for r in packing.prefix_sums(sizes, "k", "n", block=7).collect()}
    assert out == {k: sum(x % 5 for x in range(0, k, 3)) for k in range(0, 50, 3)}


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_the_tightest(lengths):
    lengths = sorted(lengths, reverse=True)
    places, offsets = best_fit_decreasing(lengths, 64)
    left: list[int] = []
    for n, place, offset in zip(lengths, places, offsets, strict=True):
        fits = [r for r in left if r >= n]
        if place == len(left):
            assert not fits
            left.append(64)
        else:
            assert left[place] == min(fits)
        assert offset == 64 - left[place]
        left[place] -= n


def test_tree_is_empty_at_first():
    tree = CapacityTree(8)
    assert tree.take(0) is None
    tree.put(5, 1)
    assert tree.take(6) is None and tree.take(2) == (5, 1) and tree.take(2) is None
