"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by membership pattern (the set of sources that hold them). The flow network has
one node per pattern, with an arc for every repetition of its words up to `repeats`, each dearer than
the last (a convex cost), and one node per source, whose arc to the sink carries its quota. The cheapest
flow that fills the quotas says how many words each pattern gives to each source. Each pattern then
takes whole rounds of its documents, and for the last round the documents first in a seeded order, the
last of them cut to the words that are still owed.

The network is built on the driver: its size is the number of patterns and sources, not of documents.
The order inside a pattern is found in two steps, a histogram over seeded buckets and then the one
bucket where the quota ends, so no pattern is ever sorted in one task.

Nulls: a null text has size 0, a null source is a source of its own, ordered last; a null id is kept.
Sizes of 0 take nothing. Repeated rows of one id count as rows, each with a seeded place of its own by
id and text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import splits, written

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096
#: Patterns of sources, each a node of the network and a row of what is broadcast, at most.
MOST_PATTERNS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def capped_targets(sizes: dict, weights: dict, total: float, most: float = 2.0) -> dict:
    """Share `total` by weight; a source stops at `most` times its size and the excess is shared anew."""
    left, out, rest = dict(sizes), {}, total
    while left:
        unit = rest / sum(weights[s] for s in left)
        over = [s for s in left if unit * weights[s] > most * left[s]]
        if not over:
            return out | {s: unit * weights[s] for s in left}
        for s in over:
            out[s] = most * left.pop(s)
            rest -= out[s]
    return out


def min_cost_flow(supply: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple[tuple, object], int]:
    """Words that each pattern gives each of its sources: successive cheapest paths with potentials.

    supply: words of a pattern (a tuple of sources). The r-th repetition of a word costs r, so single use
    comes before repetition wherever a quota can be met either way."""
    names = ["s", "t", *(("p", p) for p in supply), *(("q", q) for q in quotas)]
    at = {n: i for i, n in enumerate(names)}
    graph: list[list[list]] = [[] for _ in names]

    def arc(a: object, b: object, cap: int, cost: int) -> list:
        there, back = [at[b], cap, cost, None], [at[a], 0, -cost, None]
        there[3], back[3] = back, there
        graph[at[a]].append(there)
        graph[at[b]].append(back)
        return there

    flows = {}
    for p, words in supply.items():
        for r in range(repeats):
            arc("s", ("p", p), words, r)
        for q in p:
            if q in quotas:
                flows[p, q] = arc(("p", p), ("q", q), words * repeats, 0)
    for q, words in quotas.items():
        arc(("q", q), "t", words, 0)
    potential = [0] * len(names)
    while True:
        far, via = [float("inf")] * len(names), [None] * len(names)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if e[1] > 0 and (nd := d + e[2] + potential[u] - potential[e[0]]) < far[e[0]]:
                    far[e[0]], via[e[0]] = nd, e
                    heapq.heappush(heap, (nd, e[0]))
        if via[1] is None:
            return {k: e[3][1] for k, e in flows.items()}
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        path, node = [], 1
        while node:
            path.append(via[node])
            node = via[node][3][0]
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            e[3][1] += push


def ordered_sources(names: Iterable) -> list:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def _places(seed: int, id_col: str, text_col: str) -> list[Column]:
    """A row's seeded place, and a second hash: both together tell rows apart."""
    both = lambda n: F.xxhash64(F.lit(n), F.col(id_col), F.col(text_col))
    return [both(seed).alias("place"), both(~seed).alias("check")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, share: float = 1.5, weights: tuple = WEIGHTS, repeats: int = 2, seed: int = 11) -> DataFrame:
    """Every row's doc_id, place, members, source (the first member), size, source_size, target, taken.

    members: an array of the sources that hold a document; by default its one source. The sizes and
    targets are those of the first member."""
    members = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    rows = docs.select(F.col(id_col).alias("doc_id"), members.alias("members"), word_count(F.col(text_col)).alias("size"), *_places(seed, id_col, text_col))
    rows = written(rows.withColumn("bucket", F.shiftrightunsigned("place", 52).cast("int")), "mix")
    patterns = rows.groupBy("members").agg(F.sum("size").cast("long").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources: the network is built on the driver")
    supply = {tuple(r.members): r.size or 0 for r in patterns}
    sources = ordered_sources({s for p in supply for s in p})
    sizes = {s: sum(n for p, n in supply.items() if s in p) for s in sources}
    heft = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    targets = capped_targets(sizes, heft, share * sum(supply.values()), repeats)
    flow = min_cost_flow({p: n for p, n in supply.items() if n}, {s: round(t) for s, t in targets.items()}, repeats)
    spark = docs.sparkSession
    plan = [(list(p), *divmod(sum(flow.get((p, s), 0) for s in p), max(1, n))) for p, n in supply.items()]
    plan_df = spark.createDataFrame(plan, "members array<string>, rounds long, rest long")
    by_source = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sources], "source string, source_size long, target double")

    # The bucket in which each pattern's last round ends, and the words taken before it.
    sums = rows.groupBy("members", "bucket").agg(F.sum("size").cast("long").alias("words"))
    before = F.sum("words").over(Window.partitionBy("members").orderBy("bucket")) - F.col("words")
    cuts = sums.withColumn("before", before).join(F.broadcast(plan_df), [sums.members.eqNullSafe(plan_df.members)]).where("before <= rest and before + words > rest")
    cut_df = spark.createDataFrame([(list(r[0]), r.bucket, r.before) for r in cuts.select(sums.members, "bucket", "before").collect()], "members array<string>, cut int, before long")
    known = plan_df.alias("p").join(cut_df.alias("c"), F.col("p.members").eqNullSafe(F.col("c.members")), "left").select(F.col("p.members").alias("pattern"), "rounds", "rest", "cut", "before")

    # One row a pattern: as many as there are sources and overlaps, which the driver has held already.
    told = rows.join(F.broadcast(known), rows.members.eqNullSafe(F.col("pattern")), "left").join(F.broadcast(by_source), F.element_at("members", 1).eqNullSafe(F.col("source")), "left")
    told = told.withColumn("round", F.when(F.col("cut").isNull() & (F.col("rest") > 0), F.col("size")).when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    keep = ["doc_id", "place", "check", "members", "source", "size", "source_size", "target", "rounds"]
    inside = Window.partitionBy("members", "bucket").orderBy("place", "check", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = told.where("bucket = cut").withColumn("run", F.sum("size").over(inside) - F.col("size") + F.col("before"))
    last = last.withColumn("round", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("run"))).cast("long"))
    parts = told.where("cut is null or bucket <> cut").select(*keep, "round").unionByName(last.select(*keep, "round"))
    return parts.withColumn("taken", (F.col("rounds") * F.col("size") + F.col("round")).cast("long")).drop("rounds", "round")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **how: object) -> DataFrame:
    """The rows of docs as often as the mix takes their words; a last, partial copy keeps its first words.

    All columns stay, whatever their names. Of rows alike in id and text each has its own take; which of them has
    which does not matter but for other columns, so they are dealt in no order."""
    keys = ["place", "check"]
    dealt = mix(docs, id_col, text_col, seed=seed, **how).select(*keys, "taken", "size")
    # How often rows of a key have each take: rows alike differ in it only where a quota ends between them.
    takes = dealt.groupBy(*keys, "taken", "size").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.expr("-taken").alias("least"), "n"))).alias("takes"), F.max("size").alias("size"), F.sum("n").alias("alike"))
    takes = takes.where("takes[0].least < 0")
    # Columns by position, as a table may hold any name.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*names).select("*", *_places(seed, own_id, text)).join(takes, keys).coalesce(splits(docs))
    # Rows of a key are numbered only where their takes differ.
    mixed_up = F.size("takes") > 1
    few = rows.where(~mixed_up).withColumn("taken", -F.col("takes")[0]["least"])
    turn = rows.where(mixed_up).withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    upto = F.aggregate("takes", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("taken")), lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.when(s["taken"].isNull() & (F.col("turn") <= s["at"] + x["n"]), -x["least"]).otherwise(s["taken"]).alias("taken")))
    rows = few.unionByName(turn.withColumn("taken", upto["taken"]).drop("turn")).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.pmod(F.col("taken"), F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("words", F.explode(copies))
    cut = F.when(F.col("words") < 0, F.col(text)).otherwise(_first_words(F.col(text), F.col("words")))
    return rows.withColumn(text, cut).select(*names).toDF(*docs.columns)


def _first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first `words` words, white space between them kept."""
    gaps = F.split(text, r"[^\x20\x09-\x0D]+", -1)
    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), words), F.slice(found, F.lit(1), words), lambda g, w: F.array(g, w))), "")
