"""Near-duplicates by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidates.

1. A document's words make shingles, its shingles a set of 64-bit hashes. Equal sets make a class with a number, and only
   the class goes on, with the set of its smallest document: copies never meet as pairs.
2. One hash permutation splits into bins; a bin's value is its smallest hash. Empty bins borrow from a bin that a fixed
   random sequence of their own names (optimal densification). Bins make bands, and a band's values a bucket.
3. A bucket's members are compared with its centres only: three members, drawn by hashes that differ from bucket to
   bucket. So pairs grow with the members, not with their square, and a member meets other centres in other bands.
4. Every member's most promising pair is verified on the full sets; what is connected then needs no further pairs;
   all others are verified. Components follow from the confirmed links by hooking and pointer jumping; of few links, on
   the driver.
5. Where the members of a bucket that were no centres then lie in several components, those of different ones are all
   compared, in blocks of bounded size. So each pair with a common bucket is compared or lies in one component.

The number of bands follows from the threshold such that a pair at it shares no bucket once in a million.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Memo, arrow, cut_to_few, in_slices, join_skewed, stretches, utf8

#: A pair at the threshold is in no common bucket with this probability at most; bins a signature has at most.
MISS, MOST_BINS = 1e-6, 160
#: Members of a block, about, and their shingles: two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 128, 500_000
#: Components of so many edges at most, each counted in both directions, are found on the driver: about 1 MB of numbers.
FEW_EDGES = 50_000

_ODD = 0x9E3779B97F4A7C15
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)  # fixed values: the multipliers of a public 64-bit finaliser


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows in a band): the most selective bands that keep the miss probability with MOST_BINS bins or fewer."""
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if rows * bands <= MOST_BINS:
            best = bands, rows
    return best


class Hasher:
    """Shingle sets and signatures of texts."""

    def __init__(self, shingle: int, bands: int = 1, rows: int = 1):
        import numpy as np
        import xxhash

        self.np, self.hash = np, xxhash
        self.shingle, self.bands, self.rows = shingle, bands, rows
        self.known = Memo(xxhash.xxh3_64_intdigest)
        bins = bands * rows
        self.edges = np.array([(b << 64) // bins + (1 if (b << 64) % bins else 0) for b in range(bins)], np.uint64)
        # Densification: for each bin, the bins that it asks in turn, and at last all of them from a place of its own.
        draw = np.random.default_rng(20140601)
        self.ask = np.concatenate([draw.integers(0, bins, (24, bins)), (draw.integers(0, bins, bins) + np.arange(bins)[:, None]) % bins])

    def mixed(self, x):
        np = self.np
        for m in _MIX:
            x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
        return x ^ (x >> np.uint64(33))

    def chained(self, first: int, arrays):
        np = self.np
        acc = np.full(len(arrays[0]), first, np.uint64)
        for a in arrays:
            acc = self.mixed(acc * np.uint64(_ODD) + a)
        return acc

    def _hashes(self, words: list[bytes]):
        return self.np.fromiter(map(self.known.__getitem__, words), self.np.uint64, len(words))

    def shingles(self, text: bytes):
        """The sorted distinct hashes of its shingles: of ``shingle`` words, or of all if it has fewer; none without words."""
        np = self.np
        h = np.concatenate([self._hashes(part.lower().split()) for part in stretches(text)])
        if not len(h):
            return h
        n = min(self.shingle, len(h))
        return np.unique(self.chained(n, [h[k : len(h) - n + 1 + k] for k in range(n)]))

    def buckets(self, shingles):
        """A bucket for each band."""
        np = self.np
        at = np.searchsorted(shingles, self.edges)
        full = at < np.append(at[1:], len(shingles))
        values = shingles[np.minimum(at, len(shingles) - 1)]
        if not full.all():
            empty = np.flatnonzero(~full)
            source = np.zeros(len(full), np.int64)
            for asked in self.ask:
                bins = asked[empty]
                there = full[bins]
                source[empty[there]] = bins[there]
                empty = empty[~there]
                if not len(empty):
                    break
            values = np.where(full, values, values[source])
        table = values.reshape(self.bands, self.rows)
        return self.chained(0, [np.arange(self.bands, dtype=np.uint64), *table.T]).view(np.int64)

    def key(self, shingles) -> bytes:
        return self.hash.xxh3_128_digest(shingles.tobytes())


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """``doc_id, n_shingles, key`` (128 bits of the set; null if empty), ``buckets`` (empty if no other set can be near), ``digest`` (of the text)."""
    kind = df.schema[id_col].dataType.simpleString()
    bands, rows = bands_for(threshold)
    # Sets of n and n + 1 shingles are n / (n + 1) similar at best; with fewer only equal sets can link.
    least = threshold / (1 - threshold) - 1e-9 if threshold < 1 else math.inf

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(shingle, bands, rows)
        for batch in in_slices(batches):
            sizes, keys, buckets = [], [], []
            for text in utf8(batch.column(1)):
                own = hasher.shingles(text)
                sizes.append(len(own))
                keys.append(hasher.key(own) if len(own) else None)
                buckets.append(hasher.buckets(own) if len(own) >= least else [])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "buckets", "digest"])

    text = F.col(text_col).cast("string")
    return arrow(df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest")), run, f"doc_id {kind}, n_shingles long, key binary, buckets array<long>, digest long")


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """``doc, set`` from ``doc, key, text``: the full set of each text whose set has that key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(shingle)
        for batch in in_slices(batches):
            docs, sets = [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                own = hasher.shingles(text)
                if hasher.key(own) == key:
                    docs.append(doc)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc", "set"])

    return arrow(df.select("doc", "key", "text"), run, "doc long, set array<long>")


def bucket_members(reps: DataFrame) -> DataFrame:
    """``bucket, rep, n, c1, c2, c3`` from ``rep, buckets``: members of buckets that have others, with the three centres."""
    members = reps.select("rep", F.explode("buckets").alias("bucket"))
    first, second = F.xxhash64("bucket", "rep"), F.xxhash64("rep", "bucket", F.lit(1))
    stars = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("rep", first).alias("c1"), F.min_by("rep", second).alias("c2"), F.max_by("rep", first).alias("c3"))
    stars = cut_to_few(stars.filter("n > 1"))
    return join_skewed(members, stars, "bucket", "n", ["n", "c1", "c2", "c3"], F.col("rep")).select("bucket", "rep", "n", "c1", "c2", "c3").filter("c1 is not null")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """``member, centre, shared`` (buckets): stars around three centres of each bucket."""
    spokes = members.select("rep", F.explode(F.array_distinct(F.array("c1", "c2", "c3"))).alias("centre")).filter("rep <> centre")
    return spokes.groupBy(F.col("rep").alias("member"), "centre").agg(F.count("*").alias("shared"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The ``member, centre`` pairs that reach the threshold on their full sets.

    Centres, of which some are in very many pairs, are joined first, while rows are narrow; Spark splits such partitions.
    """
    above, below = threshold
    a = sets.select(F.col("doc").alias("centre"), F.col("set").alias("_cs"))
    b = sets.select(F.col("doc").alias("member"), F.col("set").alias("_ms"))
    both = pairs.select("member", "centre").join(a, "centre").join(b, "member")
    common = F.size(F.array_intersect("_cs", "_ms"))
    union = F.size("_cs") + F.size("_ms") - common
    return both.filter(common * below >= union * above).select("member", "centre")


def components_of_few(rows: list) -> list[tuple]:
    """(node, the smallest node of its component) for all nodes of (a, b) rows."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in rows:
        a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of ``a, b`` edges; of more than FEW_EDGES nothing is gathered in one place."""
    both = cut_to_few(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    if both.count() <= FEW_EDGES:
        kind = both.schema["a"].dataType.simpleString()
        return both.sparkSession.createDataFrame(components_of_few(both.filter("a <= b").collect()), f"node {kind}, component {kind}")
    labels = cut_to_few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        hooked = told.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = cut_to_few(hooked.join(target, "label").select("node", "old", F.least("label", "beyond").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _merged(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Components of edges between members of the components found so far."""
    name = found.select(F.col("node"), F.col("component"))
    return (
        edges.join(name.toDF("member", "_ca"), "member", "left")
        .join(name.toDF("centre", "_cb"), "centre", "left")
        .select(F.coalesce("_ca", "member").alias("a"), F.coalesce("_cb", "centre").alias("b"), "member", "centre")
        .filter("a <> b")
    )


def _carried(found: DataFrame, outer: DataFrame) -> DataFrame:
    """``node, component`` of nodes whose components ``found`` (or who themselves) are nodes of ``outer``."""
    joined = found.join(outer.toDF("component", "_outer"), "component", "left").select("node", F.coalesce("_outer", "component").alias("component"))
    return joined.unionByName(outer.join(found.select(F.col("component").alias("_known")), F.col("node") == F.col("_known"), "left_anti"))


def open_members(members: DataFrame, of: DataFrame, sets: DataFrame) -> DataFrame:
    """``bucket, i, j, rep, label``: members in the cells where pairs meet that no centre has compared.

    Members that are no centre are dealt into blocks, those of the bucket's largest component apart; a cell is two blocks,
    not both of that component. Buckets with the same such members count once.
    """
    sizes = sets.select(F.col("doc").alias("rep"), F.size("set").alias("_size")).groupBy("rep").agg(F.max("_size").alias("size"))
    rest = members.filter("n > 3 and rep <> c1 and rep <> c2 and rep <> c3").select("bucket", "rep")
    rest = rest.join(of.toDF("rep", "_component"), "rep", "left").join(sizes, "rep").select("bucket", "rep", "size", F.coalesce("_component", "rep").alias("label"))
    rest = cut_to_few(rest)
    parts = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    whole = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        F.max(F.struct("n", "size", "label")).alias("main"),
    )
    whole = whole.filter("parts > 1").dropDuplicates(["n", "x", "y"])

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    whole = whole.select("bucket", "n", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("inner"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("outer"))
    placed = join_skewed(rest, cut_to_few(whole), "bucket", "n", ["main", "inner", "outer"], F.col("rep")).filter("outer is not null")
    draw = F.xxhash64("rep", F.lit(2))
    within = F.col("label") == F.col("main")
    placed = placed.withColumn("block", F.when(within, F.col("outer") + F.pmod(draw, F.col("inner"))).otherwise(F.pmod(draw, F.col("outer"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(within, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))))
    return placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "label")


def common_counts(sets: list):
    """How many values each two of the sorted sets share."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    keep = (n > 1)[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int((n > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def block_links(cells: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``a, b``: labels that a pair within a cell links, as a spanning forest of each cell."""
    above, below = threshold
    ship(cells.sparkSession)
    kind = cells.schema["label"].dataType.simpleString()

    def meet(table):
        import numpy as np
        import pyarrow as pa

        rows = {}
        for rep, label, own in zip(table.column("rep").to_pylist(), table.column("label").to_pylist(), table.column("set").combine_chunks(), strict=True):
            rows.setdefault(rep, (label, own.values.to_numpy(zero_copy_only=False)))
        labels, own = [x for x, _ in rows.values()], [x for _, x in rows.values()]
        sizes = np.array([len(x) for x in own], np.int64)
        common = common_counts(own)
        near = common * below >= (sizes[:, None] + sizes[None, :] - common) * above
        root = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for p, q in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = find(labels[p]), find(labels[q])
            if a != b:
                root[a] = b
                links.append((labels[p], labels[q]))
        kinds = table.schema.field("label").type
        return pa.table({"a": pa.array([a for a, _ in links], kinds), "b": pa.array([b for _, b in links], kinds)})

    held = cells.join(sets.select(F.col("doc").alias("rep"), "set"), "rep").select("bucket", "i", "j", "rep", "label", "set")
    return held.groupBy("bucket", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of df: ``doc_id, n_shingles, component_id``, the smallest id that links reach, itself included.

    Two documents are linked if ``100 * |A & B| >= 80 * |A | B|`` (for the threshold 80 of 100) on their full shingle sets.
    Null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one
    shingle. Rows that repeat an id and text count as copies of each other; rows of one id with different texts have a
    component each. A null id takes its component from its copies and links to nothing else. An empty table gives no
    rows. Other columns are not read.
    """
    sig = cut_to_few(signatures(df, id_col, text_col, shingle, threshold[0] / threshold[1]))
    classes = sig.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # The node of a class is a number of its own, for an id may stand for several; the cut keeps it.
    classes = cut_to_few(classes.withColumn("rep", F.monotonically_increasing_id()))
    heads = classes.filter("least is not null").select(F.col("key").alias("_key"), "least", "rep")
    first = sig.filter(F.size("buckets") > 0).join(heads, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("least")))
    reps = cut_to_few(first.dropDuplicates(["key", "doc_id"]).select("rep", "buckets", "key", "doc_id", "digest"))
    members = cut_to_few(bucket_members(reps))
    pairs = cut_to_few(candidate_pairs(members))
    needed = pairs.select(F.explode(F.array("member", "centre")).alias("doc")).distinct()
    needed = needed.join(reps.select(F.col("rep").alias("doc"), "key", F.col("doc_id").alias("_need"), F.col("digest").alias("_digest")), "doc")
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).alias("_doc"), text.alias("text"), F.xxhash64(text).alias("_own")).join(needed, (F.col("_doc") == F.col("_need")) & (F.col("_own") == F.col("_digest")))
    sets = cut_to_few(shingle_sets(texts, shingle))
    best = pairs.groupBy("member").agg(F.max_by("centre", F.struct("shared", F.xxhash64("member", "centre"))).alias("centre"))
    links = cut_to_few(verified(best, sets, threshold))
    found = connected_components(links.toDF("a", "b"))
    rest = cut_to_few(_merged(pairs.select("member", "centre"), found))
    more = verified(rest, sets, threshold).join(rest, ["member", "centre"]).select("a", "b")
    outer = connected_components(more)
    of = cut_to_few(_carried(found, outer))
    cells = cut_to_few(open_members(members, of, sets))
    if not cells.isEmpty():
        last = cut_to_few(block_links(cells, sets, threshold))
        of = _carried(of, connected_components(last))
    of = cut_to_few(classes.join(of, F.col("rep") == F.col("node"), "left").select("key", "copies", "least", F.coalesce("component", "rep").alias("component")))
    # join_skewed() reads its second table twice, so what makes that table is computed before.
    smallest = cut_to_few(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    named = cut_to_few(join_skewed(of, smallest, "component", "classes", ["component_id"], F.col("key")).select("key", "copies", "component_id"))
    out = join_skewed(sig.select("doc_id", "n_shingles", "key"), named, "key", "copies", ["component_id"], F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of df that stay, one document of each component, all columns, whatever their names.

    The document of the smallest id stays; rows that share its id stay with it, and so do rows without an id, and those
    without words. An empty table stays empty.
    """
    names = df.columns
    gone = components(df, id_col, text_col, shingle, threshold).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    inner = df.toDF(*[f"c{k}" for k in range(len(names))])
    return inner.join(gone, inner[names.index(id_col)] == F.col("gone"), "left_anti").toDF(*names)
