"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Base spans are found by pattern. Every found value, and every further token that looks like a key, is a
candidate; candidates are counted over the corpus by distinct repositories and distinct owners. A value
that many owners or many repositories hold is a copied example, one that few of both hold looks live. Tokens
that look live are added to the spans; base spans always stay.

Positions come from the pieces between the matches: split and regexp_extract_all walk a text alike, so
the lengths of pieces and matches add up to every match's place, in code points. They are summed by blocks
of the square root of their number, so a text of very many matches costs little more for each.

Nulls: a null text is an empty one without spans; a null owner or repository counts as one of its own
(all nulls together); a null id stays null. Repeated rows are scanned on their own. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .fingerprints import let

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches of 24 and more: runs are maximal either way.
LONG_HEX = r"[0-9a-f]{24,}"
KEYLIKE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "token")
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def spans(text: Column, pattern: str, kind: str, value: Column | None, keep) -> Column:
    """Spans of a pattern's leftmost matches that do not overlap, those whose value passes `keep`."""

    add = lambda acc, x: acc + x

    def placed(gaps: Column, found: Column) -> Column:
        # What lies between the starts of a match and of the one before it.
        steps = F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g, i: F.length(g) + F.when(i > 0, F.length(F.element_at(found, i))).otherwise(0))
        return let(steps, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: blocks(x, width, found)))

    def blocks(steps: Column, width: Column, found: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(steps).cast("int"), width), lambda at: F.aggregate(F.slice(steps, F.lit(1), at), F.lit(0), add))

        def one(m: Column, i: Column, sums: Column) -> Column:
            inside = F.slice(steps, (F.floor(i / width) * width + 1).cast("int"), F.pmod(i, width) + 1)
            start = F.element_at(sums, (F.floor(i / width) + 1).cast("int")) + F.aggregate(inside, F.lit(0), add)
            return let(start, lambda at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(m)).alias("stop"), (value(m) if value else m).alias("value")))

        return F.filter(let(before, lambda sums: F.transform(found, lambda m, i: one(m, i, sums))), lambda s: keep(s["value"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: placed(g, m))))
    return F.coalesce(F.when(text.rlike(pattern), made), F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Assignments, access keys and hexadecimal runs, by start and then by kind."""
    assign = spans(text, ASSIGN, "assign", lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.length(v) >= 6)
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, "access", None, lambda v: F.length(v) >= 20)).otherwise(F.array().cast(SPAN))
    runs = spans(text, LONG_HEX, "hex", None, lambda v: F.length(v) >= 24)
    return F.array_sort(F.concat(assign, access, runs))


def keylike_spans(text: Column) -> Column:
    """Further tokens with capitals, small letters and digits, the mark of random keys."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    return spans(text, KEYLIKE, "token", None, mixed)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of candidates (hash, repository, owner), summed before the shuffle."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return found.groupBy("hash").agg(F.countDistinct(named("repository")).alias("n_repositories"), F.countDistinct(named("owner")).alias("n_owners"))


def _apart(found: DataFrame) -> DataFrame:
    """found (row, span, ...) without the tokens that overlap a base span of their row."""
    token = KINDS.index("token")
    order = F.struct("span.start", "span.kind")
    base = F.col("span.kind") != token
    passed = Window.partitionBy("row").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coming = Window.partitionBy("row").orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = found.withColumn("last", F.max(F.when(base, F.col("span.stop"))).over(passed)).withColumn("next", F.min(F.when(base, F.col("span.start"))).over(coming))
    apart = F.coalesce(F.col("last") <= F.col("span.start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("span.stop"), F.lit(True))
    return marked.where(base | apart).drop("last", "next")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """doc_id, base (spans), added (live-looking tokens), n_live, n_copied (values by ownership),
    n_repositories (the most repositories that hold one of its values).

    A value is live if at most `most_owners` owners and at most `most_repositories` repositories hold it.
    repository_col: by default every document is a repository, copies of one text being the same."""
    text = text_of(text_col)
    repository = F.col(repository_col) if repository_col else F.xxhash64(text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), repository.alias("repository"), base_spans(text).alias("base"), keylike_spans(text).alias("more"))
    rows = written(rows, "scanned")
    found = _apart(rows.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))).withColumn("hash", F.sha2("span.value", 256))
    # The join reads scans on both sides, so that an example found everywhere can be split at run time.
    found = written(found, "candidates")
    few = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    known = found.join(written(ownership(found), "ownership"), "hash").withColumn("live", few)
    token = KINDS.index("token")
    told = known.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("span.kind") == token), F.col("span")))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
        F.max("n_repositories").alias("n_repositories"),
    )
    none = F.array().cast(SPAN)
    return rows.join(told, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"))


def printed(found: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")
