"""Closed frequent itemsets of baskets by N-lists over prefix trees, one suffix class at a time.

Items are ranked by support, the most frequent first. A basket goes to the class of each of its items (rare ones
share classes by a hash) as its prefix up to that item; equal prefixes are summed before and in the shuffle. A
task builds the prefix tree of one class, numbers its nodes in pre- and post-order, and has each item's N-list:
(pre, post, count) of its nodes. Two N-lists are merged in the order of their pre-numbers: a node lies below another
if its pre-number is larger and its post-number smaller. So supports of longer sets come from merges alone.

Closures: an item with the support of the set that it extends joins it at once. What is left are sets that a set
with a *later* item contains at equal support. Such a set is a proper prefix of the larger one (in the order of ranks,
beside what both share), so every set names its prefixes, and an equality of (items, support) finds those that are
not closed: within a class in the task, across classes as a join of results.

Nothing that grows with the input meets in one task: a basket holds frequent items only, of which there are at most
`share` times the mean basket's size; a class with more than `most` distinct prefixes is cut by its next item into
classes of their own, again and again (`_cut`), whose sets carry that suffix. What is broadcast or numbered in one task
is a row per frequent item, by the same bound; beyond `SMALL` rows it is joined, not broadcast.

Nulls: rows without a basket or an item do not count. Repeated rows count once. Ties of support are ranked by item.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import splits, tidy, written

#: Distinct prefixes of one class in a task.
MOST = 1 << 20
#: Frequent items that are broadcast at most.
SMALL = 1 << 17
#: In a suffix: ends the items that came in with one cut.
END = -1
_MIX = 0x9E3779B1


def class_of(rank: np.ndarray, own: int, shared: int) -> np.ndarray:
    """The first `own` ranks are classes of their own, the others share the rest."""
    return np.where(rank < own, rank, own + (rank.astype(np.int64) * _MIX >> 7) % shared)


def prefixes(baskets: DataFrame, own: int, shared: int) -> DataFrame:
    """(suffix, class, items, n) from (ranks, n): for every class of a basket its prefix up to the last item of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("ranks").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = b.column("ranks").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), sizes)
            start = np.cumsum(sizes) - sizes
            of = class_of(flat, own, shared)
            order = np.lexsort((np.arange(len(flat)), of, row))
            last = order[np.r_[(np.diff(row[order]) != 0) | (np.diff(of[order]) != 0), True]]
            data = flat.tobytes()
            items = [data[4 * a : 4 * z + 4] for a, z in zip(start[row[last]].tolist(), last.tolist(), strict=True)]
            n = b.column("n").to_numpy()[row[last]]
            yield pa.RecordBatch.from_pydict({"suffix": pa.array([b""] * len(last), pa.binary()), "class": pa.array(of[last], pa.int64()), "items": pa.array(items, pa.binary()), "n": pa.array(n, pa.int64())})

    return _summed(baskets.mapInArrow(tidy(run), "suffix binary, class long, items binary, n long"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("suffix", "class", "items").agg(F.sum("n").alias("n"))


class Tree:
    """The prefix tree of weighted rows of ranks, and the N-list of every item."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        start, at = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        item, parent, count, levels, nodes = [np.array([-1])], [np.array([-1])], [np.array([n.sum()])], [], 1
        rows, depth = np.flatnonzero(sizes), 0
        while len(rows):
            found, inverse = np.unique(at[rows] << 32 | flat[start[rows] + depth], return_inverse=True)
            at[rows] = nodes + inverse
            item.append(found & 0xFFFFFFFF)
            parent.append(found >> 32)
            count.append(np.bincount(inverse, n[rows]).astype(np.int64))
            levels.append((nodes, nodes + len(found)))
            nodes += len(found)
            depth += 1
            rows = rows[sizes[rows] > depth]
        self.item, self.parent, self.count = map(np.concatenate, (item, parent, count))
        size, self.pre, level = np.ones(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for low, high in reversed(levels):
            np.add.at(size, self.parent[low:high], size[low:high])
        for d, (low, high) in enumerate(levels, 1):
            above = self.parent[low:high]
            before = np.cumsum(size[low:high]) - size[low:high]
            first = np.r_[True, above[1:] != above[:-1]]
            self.pre[low:high] = self.pre[above] + 1 + before - before[first][np.cumsum(first) - 1]
            level[low:high] = d
        self.post = self.pre + size - 1 - level
        order = np.lexsort((self.pre, self.item))[1:]  # without the root
        names, starts = np.unique(self.item[order], return_index=True)
        self.nodes = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))

    def list_of(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.nodes[item]
        return self.pre[at], self.post[at], self.count[at]

    def above(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The items on the paths to the nodes of an item, with their supports together with it."""
        at, n = self.nodes[item], self.count[self.nodes[item]]
        items, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = self.parent[at]
        while (own := at > 0).any():
            at, n = at[own], n[own]
            items.append(self.item[at])
            counts.append(n)
            at = self.parent[at]
        names, inverse = np.unique(np.concatenate(items), return_inverse=True)
        return names, np.bincount(inverse, np.concatenate(counts), minlength=len(names)).astype(np.int64)


def merged(above: tuple, below: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The N-list of a set with one more frequent item, from that item's and the set's."""
    at = np.searchsorted(above[0], below[0]) - 1
    held = at >= 0
    held[held] = above[1][at[held]] > below[1][held]
    count = np.bincount(at[held], below[2][held], minlength=len(above[0])).astype(np.int64)
    keep = count > 0
    return above[0][keep], above[1][keep], count[keep]


def _extended(tree: Tree, item: int, least: int, frozen: tuple) -> Iterator[tuple[tuple, int, list]]:
    """(items, support, the sets it grew from) of every set of a class whose last item this is, with what lies before it."""
    names, supports = tree.above(item)
    own = tree.list_of(item)
    stack = [((*frozen, item), own, int(own[2].sum()), names[supports >= least].tolist(), [frozen])]
    while stack:
        items, nodes, support, more, grown = stack.pop()
        if support < least:
            continue
        kids = []
        for x in more:
            longer = merged(tree.list_of(x), nodes)
            s = int(longer[2].sum())
            if s == support:
                items = (*items, x)
            elif s >= least:
                kids.append((x, longer, s))
        yield tuple(sorted(items)), support, grown
        for i, (x, longer, s) in enumerate(kids):
            stack.append(((*items, x), longer, s, [y for y, _, _ in kids[:i]], [*grown, items]))


def _shorter(items: tuple, grown: list) -> Iterator[tuple]:
    """What a set shows not to be closed, if its support is the same: what it grew from with a part, in order, of the rest."""
    for own in grown:
        held = set(own)
        rest = [x for x in items if x not in held]
        for i in range(1, len(rest)):
            yield tuple(sorted((*own, *rest[:i])))


def _suffixes(suffix: bytes) -> list[tuple]:
    """A suffix as the sets that its cuts made, the empty one first."""
    out, own = [()], []
    for x in np.frombuffer(suffix, np.int32).tolist():
        if x == END:
            out.append(tuple(own))
        else:
            own.append(x)
    return out


def _bytes(items) -> bytes:
    return np.array(items, np.int32).tobytes()


def _mined(own: int, shared: int, least: int):
    """One class to (items, support, closed): its sets, and what they show not to be closed in other classes (closed: false)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        suffix = table["suffix"][0].as_py()
        parts = [np.frombuffer(x, np.int32) for x in table["items"].to_pylist()]
        sizes, flat, n = np.array([len(x) for x in parts]), np.concatenate(parts), table["n"].to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        names, inverse = np.unique(flat, return_inverse=True)
        keep = np.bincount(inverse, n[row])[inverse] >= least
        tree = Tree(flat[keep].astype(np.int64), np.bincount(row[keep], minlength=len(sizes)), n)
        chain = _suffixes(suffix)
        mine = np.array(sorted(tree.nodes), np.int64)
        of = class_of(mine, own, shared) if len(chain) == 1 else mine
        found, dead, elsewhere = [], set(), set()
        for item in mine[of == table["class"][0].as_py()].tolist():
            for items, support, grown in _extended(tree, item, least, chain[-1]):
                found.append((items, support))
                dead.update((x, support) for x in _shorter(items, grown[1:]))
                elsewhere.update((x, support) for x in _shorter(items, chain))
        rows = [(i, s, True) for i, s in found if (i, s) not in dead] + [(i, s, False) for i, s in elsewhere]
        return pa.table({"items": pa.array([_bytes(i) for i, _, _ in rows], pa.binary()), "support": pa.array([s for _, s, _ in rows], pa.int64()), "closed": pa.array([c for _, _, c in rows], pa.bool_())})

    return run


def _cut(classes: DataFrame, large: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes of one item cut by the item before it: (classes, the sets that are the suffixes of these)."""
    own = classes.join(large, ["suffix", "class"], "left_semi")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                items = [np.frombuffer(x, np.int32) for x in b.column("items").to_pylist()]
                yield pa.RecordBatch.from_pydict({"suffix": b.column("suffix"), "class": b.column("class"), "n": b.column("n"), "ranks": pa.array(items, pa.list_(pa.int32()))})

    rows = written(own.mapInArrow(tidy(opened), "suffix binary, class long, n long, ranks array<int>"), "cut", splits(classes))
    # A row per class and item: at most as many as there are frequent items.
    sums = rows.select("suffix", "class", "n", F.explode("ranks").alias("rank")).groupBy("suffix", "class", "rank").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("rank") == F.col("class"), F.col("n"))).over(Window.partitionBy("suffix", "class"))
    told = sums.withColumn("total", total).where((F.col("n") >= least) & (F.col("rank") != F.col("class")))
    told = told.groupBy("suffix", "class").agg(
        F.collect_list(F.when(F.col("n") == F.col("total"), F.col("rank").cast("int"))).alias("joined"),
        F.collect_list(F.when(F.col("n") < F.col("total"), F.col("rank").cast("int"))).alias("frequent"),
    )
    totals = rows.groupBy("suffix", "class").agg(F.sum("n").alias("total"))
    told = written(totals.join(told, ["suffix", "class"], "left"), "suffixes", 1)

    def longer(b: pa.RecordBatch) -> list[bytes]:
        whole = zip(b.column("suffix").to_pylist(), b.column("class").to_pylist(), b.column("joined").to_pylist(), strict=True)
        return [s + _bytes([c, *(j or ()), END]) for s, c, j in whole]

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for suffix, ranks, frequent, n in zip(longer(b), b.column("ranks").to_pylist(), b.column("frequent").to_pylist(), b.column("n").to_pylist(), strict=True):
                known = set(frequent or ())
                body = [x for x in ranks if x in known]
                data = _bytes(body)
                out += [(suffix, x, data[: 4 * i + 4], n) for i, x in enumerate(body)]
            if out:
                suffix, name, items, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"suffix": pa.array(suffix, pa.binary()), "class": pa.array(name, pa.int64()), "items": pa.array(items, pa.binary()), "n": pa.array(n, pa.int64())})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for suffix, support in zip(longer(b), b.column("total").to_pylist(), strict=True):
                chain = _suffixes(suffix)
                items = tuple(sorted(chain[-1]))
                rows += [(items, support, True), *((x, support, False) for x in set(_shorter(items, chain[:-1])))]
            if rows:
                yield pa.RecordBatch.from_pydict({"items": pa.array([_bytes(i) for i, _, _ in rows], pa.binary()), "support": pa.array([s for _, s, _ in rows], pa.int64()), "closed": pa.array([c for _, _, c in rows], pa.bool_())})

    classes = rows.join(told.drop("total"), ["suffix", "class"]).mapInArrow(tidy(emitted), "suffix binary, class long, items binary, n long")
    return _summed(classes), told.mapInArrow(tidy(sets), "items binary, support long, closed boolean")


def itemsets(rows: DataFrame, basket_col: str, item_col: str, least: int = 12, share: int = 10_000, most: int = MOST) -> tuple[DataFrame, DataFrame, int]:
    """The closed itemsets (items, support), all ranks of them ascending, in at least `least` baskets and one in `share`;
    the frequent items (rank, item, support); and the number of baskets."""
    spark, files = rows.sparkSession, splits(rows)
    pairs = rows.select(F.col(basket_col).alias("basket"), F.col(item_col).cast("long").alias("item")).where("basket is not null and item is not null")
    baskets = rows.where(F.col(basket_col).isNotNull() & F.col(item_col).isNotNull()).select(basket_col).distinct().count()
    pairs = written(pairs.distinct(), "pairs", files)
    counts = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where((F.col("support") >= least) & (F.col("support").cast("decimal(38,0)") * share >= baskets))
    frequent = written(counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("support"), "item")) - 1).select("rank", "item", "support"), "frequent", 1)
    least = max(least, -(-baskets // share))
    told = frequent.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("support") > most // 8).alias("own"), F.coalesce(F.sum(F.when(F.col("support") <= most // 8, F.col("support"))), F.lit(0)).alias("rest")).first()
    shared = max(1, min(told.n, max(-(-told.rest // (most // 4 or 1)), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ranked = pairs.join(_small(frequent, told.n).select("item", "rank"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    classes = written(prefixes(ranked.select("ranks", F.lit(1).cast("long").alias("n")), told.own, shared), "classes", files)
    schema, found = "items binary, support long, closed boolean", None
    while True:
        # Classes of several items are cut by their hash; only those of one item may be larger.
        large = classes.groupBy("suffix", "class").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > most) & ((F.octet_length("suffix") > 0) | (F.col("class") < told.own)))
        large = written(large.select("suffix", "class"), "large", 1)
        cut = not large.isEmpty()
        small = classes.join(large, ["suffix", "class"], "left_anti") if cut else classes
        part = written(small.groupBy("suffix", "class").applyInArrow(_mined(told.own, shared, least), schema), "sets", files)
        found = part if found is None else found.unionByName(part)
        if not cut:
            break
        classes, suffixes = _cut(classes, large, least)
        classes, found = written(classes, "classes", files), found.unionByName(written(suffixes, "suffix-sets", files))
    closed = found.where("closed").select("items", "support")
    return written(closed.join(found.where("not closed").select("items", "support").distinct(), ["items", "support"], "left_anti"), "closed", files), frequent, baskets


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def with_items(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(items, support, members) of sets: members is an array of (item, rank, s), the item's own support, ascending by item."""
    ranks = _ranks(sets).select("items", "support", F.explode("ranks").alias("rank"))
    named = ranks.join(frequent.withColumnRenamed("support", "s"), "rank")
    return named.groupBy("items", "support").agg(F.sort_array(F.collect_list(F.struct("item", "rank", "s"))).alias("members"))


def _ranks(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [np.frombuffer(x, np.int32) for x in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_pydict({"items": b.column("items"), "support": b.column("support"), "ranks": pa.array(items, pa.list_(pa.int32()))})

    return sets.select("items", "support").mapInArrow(run, "items binary, support long, ranks array<int>")


def rules(sets: DataFrame, frequent: DataFrame, baskets: int, percent: int = 30) -> DataFrame:
    """(items, support, item, a, s) of every rule of closed sets: the rest, in `a` baskets, has the item in `percent` of
    them or more, and oftener than all baskets (of which `s` hold it).

    The rest need not be closed. Its support is that of the smallest closed set that holds it: itself, in most cases, an
    item's own, or the largest support of the closed sets that hold its rarest item and all others."""
    longer = with_items(sets.where(F.octet_length("items") > 4), frequent)
    asked = longer.select("items", "support", "members", F.explode("members").alias("m"))
    rest = F.sort_array(F.transform(F.filter("members", lambda x: x["rank"] != F.col("m.rank")), lambda x: x["rank"]))
    asked = written(asked.select("items", "support", "m.item", "m.s", rest.alias("rest")), "asked")
    closed = written(_ranks(sets).select(F.col("ranks").alias("rest"), F.col("support").alias("a")), "known")
    single = frequent.select(F.array(F.col("rank").cast("int")).alias("rest"), F.col("support").alias("a"))
    known = closed.where("size(rest) > 1").unionByName(single)
    told = written(asked.join(known, "rest", "left"), "told")
    open_ = told.where("a is null").select("rest").distinct().withColumn("rarest", F.element_at("rest", -1))
    held = closed.select(F.explode("rest").alias("rarest"), F.col("rest").alias("whole"), "a")
    within = F.size(F.array_intersect("rest", "whole")) == F.size("rest")
    others = open_.join(held, "rarest").where(within).groupBy("rest").agg(F.max("a").alias("b"))
    done = told.join(written(others, "others"), "rest", "left").withColumn("a", F.coalesce("a", "b"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    good = (wide("support") * 100 >= wide("a") * percent) & (wide("support") * F.lit(baskets).cast("decimal(19,0)") > wide("a") * wide("s"))
    return done.where(good).select("items", "support", "item", "a", "s")


def names_of(members: Column) -> Column:
    """The items of a set as one string, ascending."""
    return F.concat_ws(",", F.transform(members, lambda m: m["item"].cast("string")))
