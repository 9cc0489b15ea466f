import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup as N
from tessera.llm.queries import op10_near_dedup


def sets_of(rows, shingle):
    out = []
    for doc, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        n = min(shingle, len(w))
        out.append((doc, frozenset(b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
    return out


def brute(rows, shingle, threshold):
    sets = sets_of(rows, shingle)
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and threshold[1] * len(a & b) >= threshold[0] * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            best[find(i)] = min(doc, best.get(find(i), doc))
    return sorted(((doc, len(s), best.get(find(i)) if s else doc) for i, (doc, s) in enumerate(sets)), key=repr)


def got(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.components(df, **more).collect()), key=repr)


@pytest.mark.parametrize("threshold", [(85, 100), (80, 100)])
def test_groups_of_copies_and_chains(spark, threshold):
    draw = random.Random(3)
    rows, doc = [], 0
    for size in (1, 2, 3, 40, 8, 5):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(30, 120))]
        for k in range(size):
            own = list(base)
            for _ in range(k % 3):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
            if size == 8:  # each a step away from the one before
                base = own
            rows.append((doc * 7 % 1000, " ".join(own)))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, shingle=3, threshold=threshold) == brute(rows, 3, threshold)


def family(variants, changed, words=300, seed=11):
    """An original and variants of it that only the original links, in rows of id and text."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    rows = [" ".join(base)]
    for _ in range(variants):
        own = list(base)
        for at in draw.sample(range(words), changed):
            own[at] = f"x{draw.randrange(10**9)}"
        rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_family_that_only_the_original_links(spark):
    rows = family(300, 6)
    want = brute(rows, 3, (85, 100))
    assert len({c for _, _, c in want}) < 10
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=3, threshold=(85, 100)) == want


def test_ids_with_different_texts(spark):
    """Two families whose smallest id is the same: near copies of both are linked, and the families are not."""
    a, b = family(3, 1, 60, 1), family(3, 1, 60, 2)
    rows = [(0, a[0][1]), (0, b[0][1])] + [(k, t) for k, t in a[1:]] + [(10 + k, t) for k, t in b[1:]]
    # brute force names a component by its least id, 0 for both; each row must be linked within its own family
    want = brute(rows, 3, (80, 100))
    assert {c for _, _, c in want} == {0}
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=3, threshold=(80, 100)) == want


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op10_near_dedup(spark, sf_dir).collect()), key=repr)
    assert out == brute(rows, 3, (85, 100))


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows, 5, (80, 100))
    kept = N.deduplicate(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 5, 6, None}
    assert N.components(empty).isEmpty() and N.deduplicate(empty).isEmpty()


def test_components_of_a_path_and_a_star(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.range(101, 160).select("id", F.lit(100)))
    out = {r.node: r.component for r in N.connected_components(edges).collect()}
    assert all(out[k] == 0 for k in range(60)) and all(out[k] == 100 for k in range(100, 160))


def test_bands_keep_the_miss_probability():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands, rows = N.bands_for(t)
        assert (1 - t**rows) ** bands <= N.MISS * 1.001 and bands * rows <= N.MOST_BINS


@pytest.mark.parametrize("n", [6, 20, 200, 2000])
def test_signatures_estimate_similarity(n):
    """Densified bins of sets of any size agree about as often as the sets are similar."""
    hasher = N.Hasher(1, 40, 1)
    draw = np.random.default_rng(n)
    agree = []
    for _ in range(200):
        both = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(both[: max(1, n * 9 // 10)]), np.sort(both)
        agree.append((hasher.buckets(a) == hasher.buckets(b)).mean())
    assert abs(np.mean(agree) - len(a) / len(b)) < 0.05


def test_links_within_template_groups(spark):
    """Groups whose members are about 0.80 similar, with a few pairs at 0.85 or more: no link is lost."""
    draw, rows, want = random.Random(12), [], []
    for group in range(40):
        frame = [f"g{group}f{k}" for k in range(89)]
        own = [[f"g{group}m{m}w{k}" for k in range(11)] for m in range(120)]
        for k in range(0, 6, 2):  # pairs that share more than the frame
            own[k + 1][:4] = own[k][:4]
        for words in own:
            text = frame + words
            draw.shuffle(text)
            rows.append((len(rows), " ".join(text)))
        want += brute(rows[-120:], 1, (85, 100))  # groups have no word in common
    want.sort(key=repr)
    assert len({c for _, _, c in want}) == 40 * (120 - 3)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=1, threshold=(85, 100)) == want


def test_components_of_many_edges(spark, monkeypatch):
    """What the driver finds of few edges, rounds of joins find too."""
    draw = random.Random(5)
    rows = [(k + 1, k) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(50)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    few = sorted(map(tuple, N.connected_components(edges).collect()))
    monkeypatch.setattr(N, "FEW_EDGES", 0)
    assert sorted(map(tuple, N.connected_components(edges).collect())) == few
    assert {c for n, c in few if n <= 40} == {0} and {c for n, c in few if 100 <= n < 140} == {100}
    assert N.connected_components(edges.limit(0)).isEmpty()


def test_small_tables_take_few_tasks(spark):
    """With many shuffle partitions, few rows don't take many tasks: the driver remembers each of them."""
    rows, held = family(60, 6), {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "")
        assert got(df, shingle=3, threshold=(85, 100)) == brute(rows, 3, (85, 100))
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
        assert 0 < tasks < 2000  # 4256 when partitions stayed as they were and each component took rounds
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
