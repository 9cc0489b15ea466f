"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are always reported. Beyond them, any long token of mixed letters and digits is a candidate. What
tells a live credential from a documentation example is who has it: candidate hashes are aggregated by distinct
repositories and owners, in steps that each combine before they shuffle. A candidate that few owners have is reported as
kind ``token``; one that is copied widely is taken for an example. The base kinds get the same verdict for their values.

Positions come from the pattern alone: the text split at its matches gives the gaps, and running sums over gaps and
matches give code-point offsets, so one expression serves any number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_skewed, text_of

#: Fixed values of the contract: pattern of each base kind, in listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: [A-Z0-9]+ after AKIA with 18 characters at least. A match ends where its run ends, so whatever fails the length has no longer match inside: asking for the length in the pattern finds the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: [0-9a-f]+ with 16 characters at least; runs are maximal, so the same holds.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
#: What may be a credential besides: a run of 20 or more such characters that has a digit, a small and a large letter.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+"
#: Matches of a text that are folded together: growing a list copies it, so longer texts are folded in chunks.
CHUNK = 256
#: A value that more owners than this have is an example.
MOST_OWNERS = 2

_SPAN = "array<struct<kind:int,start:long,end:long,hash:binary>>"


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern as structs: kind, start, end (code points), hash of the value."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {_SPAN})")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["match"])
        found = F.array(F.struct(F.lit(kind).alias("kind"), begin.cast("long").alias("start"), end.cast("long").alias("end"), F.unhex(F.sha2(x["value"], 256)).alias("hash")))
        keep = F.char_length(x["value"]) >= least
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
    zipped = F.transform(F.slice(zipped, 1, F.size(matches)), lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), x["value"].alias("value")))

    def chunk(rows: Column, k: Column) -> Column:
        return F.aggregate(F.slice(rows, k * CHUNK + 1, CHUNK), start, step)

    def moved(x: Column, by: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hash"].alias("hash"))

    def add(bases: Column, part: Column) -> Column:
        return F.concat(bases, F.array(F.element_at(bases, -1) + part["at"]))

    def joined(parts: Column) -> Column:
        """Offsets within chunks become offsets in the text by the running sum of what the chunks before took."""
        bases = F.aggregate(parts, F.array(F.lit(0).cast("long")), add)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), bases.alias("base")), lambda p: F.transform(F.coalesce(p["part"]["out"], none), lambda x: moved(x, p["base"]))))

    # one() names a value, so that it is computed once and not at each use in the functions below.
    parts = one(zipped, lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: chunk(rows, k)))
    return F.when(text.rlike(pattern), one(parts, joined)).otherwise(none)


def one(value: Column, of) -> Column:
    return F.element_at(F.transform(F.array(value), of), 1)


def find_candidates(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str | None) -> DataFrame:
    text = F.col("_text")
    docs = df.select(F.col(id_col).alias("doc_id"), text_of(df[repo_col]).alias("_repo"), text_of(df[owner_col or repo_col]).alias("_owner"), text_of(df[text_col]).alias("_text"))
    base = [spans_of(text, ASSIGN, 0, 2, ASSIGN_LEAST), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)]
    return docs.select("doc_id", "_repo", "_owner", F.concat(*base, spans_of(text, TOKEN, 3)).alias("_spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_rows, n_repos, n_owners`` of rows with _hash, _repo, _owner; combines before each of three small shuffles."""
    repos = candidates.groupBy("_hash", "_owner", "_repo").agg(F.count("*").alias("_n"))
    owners = repos.groupBy("_hash", "_owner").agg(F.sum("_n").alias("_n"), F.count("*").alias("_repos"))
    return owners.groupBy("_hash").agg(F.sum("_n").alias("n_rows"), F.sum("_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row of df: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example``.

    ``spans``: kind:start:end of all findings by start, then kind. ``owner_col`` defaults to the repository. n_live and
    n_example count the findings whose value few, or more than ``most_owners``, owners have. Null text is empty; a null
    repository or owner counts as one unnamed. Rows that repeat an id are told apart, and count once each as findings.
    An empty table gives no rows. Other columns are not read.
    """
    docs = cut(find_candidates(df, id_col, text_col, repo_col, owner_col).withColumn("_row", F.monotonically_increasing_id()))
    found = docs.filter(F.size("_spans") > 0).select("_row", "_repo", "_owner", F.explode("_spans").alias("_s")).select("_row", "_repo", "_owner", "_s.*")
    found = found.withColumnRenamed("hash", "_hash")
    owned = ownership(found)
    judged = join_skewed(found, owned, "_hash", "n_rows", ["n_owners"], F.struct("_row", "start"))
    live = F.col("n_owners") <= most_owners
    reported = F.when((F.col("kind") < len(KINDS)) | live, F.struct("start", "kind", "end"))
    # A document's findings are bounded by its length, and come back together by the row they are of.
    per_doc = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(reported)).alias("_all"),
        F.count_if(live).alias("_live"),
        F.count_if(~live).alias("_example"),
    )
    out = docs.select("_row", "doc_id").join(per_doc, "_row", "left")
    name = F.array(*[F.lit(k) for k in (*KINDS, "token")])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    everything = F.coalesce(F.col("_all"), F.expr("cast(array() as array<struct<start:long,kind:int,end:long>>)"))

    def of_kind(k: int) -> Column:
        return F.size(F.filter(everything, lambda s: s["kind"] == k)).cast("long")

    count = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = F.filter(everything, lambda s: s["kind"] < len(KINDS))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(everything).alias("spans"), F.coalesce("_live", zero).alias("n_live"), F.coalesce("_example", zero).alias("n_example"))
