import hashlib
import re

from helpers import canonical
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination as D
from tessera.llm.queries import ORACLES, op3_decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(own) - n + 1 if n else 0):
            if tuple(own[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found), hit


def test_query_same_as_duckdb(spark, sf_dir, duck):
    assert canonical(op3_decontamination(spark, sf_dir).toPandas()) == canonical(duck.sql(ORACLES["op3_decontamination"]).df())


SMALL = st.lists(st.sampled_from("a b c".split()), max_size=12).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SMALL, max_size=5), st.lists(st.sampled_from("a b c d".split()), max_size=60).map(" ".join))
def test_automaton_against_brute_force(items, text):
    items = [*enumerate(items)]
    automaton = D.SuffixAutomaton([(str(k), D.words_of(t.encode())) for k, t in items], 4)
    spans, found = automaton.hits(automaton.numbers(text.encode()))
    n, n_hit, names, hit = brute(text, items, 4)
    assert {k for a, b in spans for k in range(a, b)} == hit and sorted(found) == names
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def benchmark(spark):
    rows = [(1, "one TWO three four five six seven eight nine ten eleven"), (2, "five six seven"), (2, None), (3, "..."), (None, "word word")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows_in_blocks_of_any_size(spark, odd, empty):
    items = [(r.item_id if r.item_id is not None else "", r.text) for r in benchmark(spark).collect()]
    for block in (1000, 11, 10):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.find_contamination(odd, benchmark(spark), block_words=block).collect()), key=repr)
        assert got == sorted(((r.doc_id, *brute(r.text, items)[:3]) for r in odd.collect()), key=repr)
    assert D.find_contamination(empty, benchmark(spark)).isEmpty()
    none = D.find_contamination(odd, benchmark(spark).limit(0)).collect()
    assert len(none) == odd.count() and not any(r.n_hit for r in none)
    assert D.items_digest([]) == hashlib.sha256(b"").hexdigest()


def test_removal(spark, odd):
    filler = " ".join(f"w{k}" for k in range(40))
    passage = "One, two; three four five six seven eight nine ten!"
    rows = spark.createDataFrame([(1, f"{filler} {passage} {filler}", 9, 0), (2, passage, 9, 0), (3, filler, 9, 0), (4, None, 9, 0)], "doc_id long, text string, n_chars long, __text int")
    out = {r.doc_id: r for r in D.decontaminate(rows, benchmark(spark), length_col="n_chars").collect()}
    assert sorted(out) == [1, 3, 4] and out[3].text == filler and out[3].n_chars == 9 and out[4].text is None
    assert out[1].text == f"{filler} ! {filler}" and out[1].n_chars == len(out[1].text)
    assert D.decontaminate(odd, benchmark(spark), length_col="length").columns == odd.columns
