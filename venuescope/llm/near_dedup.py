"""SimHash near duplicates at a similarity: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Three bits of 64 are too few for this similarity, so the deletion-variant signatures of `simhash` are made
on a longer fingerprint: majority bits in segments of 24 bits, or of 32 for more than `FEW` rows, so that the sets
that meet by chance in a segment do not grow with the corpus. Sets alike in 0.8 of their shingles differ in about 15 of
100 bits; a pair is a candidate if some segment differs in at most one bit, that is if both agree in a one-wildcard
variant of it. The number of segments follows: 48 (or 144), so that a pair at 0.8 of independent bits is missed with a
probability of `MISS`; measured, it is 0.012 at 0.8 and 0.0003 at 0.85. Rows are dealt by the half of a segment that
has no wildcard; the variants of the other half are joined in the task that holds them, which holds 32 bytes of
each row. Candidates must agree in 46 of 64 further bits and are then verified on the whole shingle sets, which are
made once of every set that is ever a candidate.

Only what may join two components is verified, so that rows do not grow with the square of a group. A first
round looks at eight of the segments and verifies the nearest candidate of each set there, so that most of a
large group is joined before the others are looked at. The second takes all sets and segments and verifies the
nearest candidate that the links so far do not join, one for two components; the last one all that are left.
There, for the sets that have more candidates, rows carry
768 bits of the fingerprint, of which candidates must agree in 627. Equal sets are merged before that. (The
limits are three and two and a half standard deviations beyond what a pair at 0.8 has.)

Nulls: a null text is an empty one; texts without words are alike. A text of fewer than five words is one
shingle. A null id sorts last; rows without one are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, one_of_each, parts_for, small_batches, splits, text_of, tidy, told_of, written
from .components import components

WORDS = 5
SEED = 42
#: Up to so many rows a segment has 24 bits.
FEW = 20_000_000
#: Of 100 bits so many differ at a similarity of 0.8; so often no segment of a pair agrees but for one.
DIFFER, MISS = 0.15, 0.005
#: Segments looked at in each round, and candidates that a task gives of each set and of two components, the nearest first; None: all.
ROUNDS = ((8, 1), (None, 1), (None, None))
#: The round from which rows carry more of the fingerprint.
WITH_PRINT = 2
#: Before the last round, members of a larger bucket are compared with so many neighbours by check bits.
LARGE, NEIGHBOURS = 64, 16
#: Of the 64 check bits and of the first 768 bits so many may differ.
CHECK, PRINT_BITS, FAR = 18, 768, 141


class Shape(NamedTuple):
    """How many segments of how many bits; a multiple of 64 in all."""

    segments: int = 48
    bits: int = 24

    @property
    def half(self) -> int:
        return self.bits // 2

    def random(self) -> tuple[np.ndarray, np.ndarray]:
        add, times = np.random.default_rng(SEED).integers(0, 1 << 63, (2, self.segments * self.bits // 64 + 1), dtype=np.uint64)
        return add, times | np.uint64(1)


def shape_of(rows: int) -> Shape:
    bits = 24 if rows <= FEW else 32
    agree = (1 - DIFFER) ** bits + bits * DIFFER * (1 - DIFFER) ** (bits - 1)
    return Shape(-(-math.ceil(math.log(MISS) / math.log(1 - agree)) // 16) * 16, bits)


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of `width` words."""
    words = text.encode().lower().split()
    if len(words) <= width:
        found = [b" ".join(words)] if words else []
    else:
        found = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)))


_random = cache(Shape.random)


def fingerprint(own: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.uint64, bytes]:
    """The segments of a shingle set's fingerprint, 64 bits more to check candidates by, and its first bits."""
    add, times = _random(shape)
    ones = np.zeros(64 * len(add), np.int64)
    for at in range(0, len(own), 1 << 10):
        mixed = (own[at : at + (1 << 10), None] ^ add) * times
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1).sum(axis=0, dtype=np.int32)
    bits = ones * 2 > len(own)
    whole = shape.segments * shape.bits
    packed = bits[:whole].reshape(shape.segments, shape.bits) @ (1 << np.arange(shape.bits - 1, -1, -1))
    return packed, np.packbits(bits[whole:]).view(np.uint64)[0], np.packbits(bits[:PRINT_BITS]).tobytes()


def signed(docs: DataFrame, text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(told, node, segments, check, print) of every row: hash of its text, hash of its shingle set, its fingerprint."""
    small_batches(docs.sparkSession)

    def made(b: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        prints = [fingerprint(s, shape) for s in sets]
        flat = np.concatenate([p[0] for p in prints])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, shape.segments), pa.int32()), pa.array(flat))
        return {"told": b.column("told"), "node": pa.array(nodes.view(np.int64)), "segments": lists, "check": pa.array(np.array([p[1] for p in prints]).view(np.int64)), "print": pa.array([p[2] for p in prints], pa.binary())}

    rows = docs.select(text_of(text_col).alias("text"), told_of(text_col).alias("told"))
    return arrow_map(rows, made, "told long, node long, segments array<long>, check long, print binary")


def _cross(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the rows x, or of rows of x and of y."""
    if y is None:
        i, j = np.triu_indices(len(x), 1)
        return x[i], x[j]
    return np.repeat(x, len(y)), np.tile(y, len(x))


def _pairs_of(x: np.ndarray, y: np.ndarray | None, check: np.ndarray, label: np.ndarray, last: bool, turn: int) -> Iterator[tuple]:
    """Pairs of rows of a bucket, whose labels may differ; before the last round of a large one, of neighbours only."""
    every = x if y is None else np.concatenate([x, y])
    if len(every) <= LARGE:
        yield _cross(x, y)
    elif not last:
        # In the order of the check bits, turned by half in the second round.
        own = check[every]
        order = every[np.argsort(own << np.uint64(turn) | own >> np.uint64(64 - turn) if turn else own)]
        for step in range(1, NEIGHBOURS + 1):
            yield order[:-step], order[step:]
    else:
        # Those of the largest label are joined already: the others meet all.
        names, counts = np.unique(label[every], return_counts=True)
        rest = every[label[every] != names[counts.argmax()]]
        for at in range(0, len(rest), 64):
            yield _cross(rest[at : at + 64], every)


def _places(far: np.ndarray, *group: np.ndarray) -> np.ndarray:
    """The place of every pair in its group, the nearest first; ties in their order."""
    order = np.lexsort((far, *group))
    starts = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in group], axis=0)])
    out = np.empty(len(far), np.int64)
    out[order] = np.arange(len(far)) - np.repeat(starts, np.diff(np.r_[starts, len(far)]))
    return out


def _nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` nearest of either of their rows, and of the two components (2 x pairs) they would join."""
    own = np.minimum(_places(far, i), _places(far, j)) < most
    return own & (_places(far, labels.min(axis=0), labels.max(axis=0)) < most)


def _met_before(differ: np.ndarray, segment: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs, of whose first bits these differ, meet in an earlier segment too: one of them is enough."""
    out = np.zeros(len(differ), bool)
    for at in range(0, len(differ), 65536):
        own = slice(at, at + 65536)
        far = np.bitwise_count(differ[own].view(np.uint8)).reshape(-1, PRINT_BITS // bits, bits // 8).sum(axis=2)
        out[own] = ((far <= 1) & (np.arange(far.shape[1]) < segment[own, None])).any(axis=1)
    return out


def _variants(most: int | None, turn: int = 0, shape: Shape = Shape()):
    """From whole halves (half, rest, node, label, check, and print if rows carry it): candidate pairs (a, b) of different labels, at most
    so many of each node and of two labels, the nearest; and (a, null) for the nodes that have more.

    rest is the half that has a wildcard. A bucket is one segment value, or two that a wildcard joins."""

    h = shape.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], []
        for b in batches:
            if b.num_rows:
                parts.append([b.column(c).to_numpy() for c in ("half", "rest", "node", "label", "check")])
                if "print" in b.schema.names:
                    held.append(np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint64).reshape(b.num_rows, -1))
        if not parts:
            return
        half, rest, node, label, check = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = half.astype(np.int64) << h | rest
        order = np.argsort(key, kind="stable")
        key, node, label, check = key[order], node[order], label[order], check[order].view(np.uint64)
        prints = np.concatenate(held)[order] if held else None
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths, values = np.diff(np.r_[starts, len(key)]), key[starts]
        found: list[np.ndarray] = [np.empty((3, 0), np.int64)]
        partial: list[np.ndarray] = [np.empty(0, np.int64)]

        def take(i: np.ndarray, j: np.ndarray) -> None:
            far = np.bitwise_count(check[i] ^ check[j]).astype(np.int64)
            close = (far <= CHECK) & (label[i] != label[j])
            i, j, far = i[close], j[close], far[close]
            if prints is not None and len(i):
                far = np.concatenate([np.bitwise_count(prints[i[at : at + 65536]] ^ prints[j[at : at + 65536]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), 65536)])
                near = far <= FAR
                near[near] &= ~_met_before(prints[i[near]] ^ prints[j[near]], key[i[near]] >> (2 * h + 1), shape.bits)
                i, j, far = i[near], j[near], far[near]
            if len(i):
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), far]))

        def bucket(x: np.ndarray, y: np.ndarray | None = None) -> None:
            for i, j in _pairs_of(x, y, check, label, most is None, turn):
                take(i, j)
            if most is not None and len(x) + (0 if y is None else len(y)) > LARGE:
                partial.append(np.unique(node[x if y is None else np.concatenate([x, y])]))

        members = lambda v: np.arange(starts[v], starts[v] + lengths[v])
        # Equal segments: both halves of a segment meet them, one is enough.
        first = (values >> (2 * h)) & 1 == 0
        for n in range(2, LARGE + 1):
            at = starts[(lengths == n) & first]
            i, j = np.triu_indices(n, 1)
            take((at[:, None] + i).ravel(), (at[:, None] + j).ravel())
        for v in np.flatnonzero((lengths > LARGE) & first):
            bucket(members(v))
        for bit in range(h):
            low = np.flatnonzero((values >> bit) & 1 == 0)
            at = np.searchsorted(values, values[low] | (1 << bit)).clip(max=len(values) - 1)
            met = values[at] == values[low] | (1 << bit)
            x, y = low[met], at[met]
            one = (lengths[x] == 1) & (lengths[y] == 1)
            take(starts[x[one]], starts[y[one]])
            for v, w in zip(x[~one], y[~one], strict=True):
                bucket(members(v), members(w))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        if most is not None and pairs.size:
            names, at = np.unique(node, return_index=True)
            keep = _nearest(*pairs, label[at][np.searchsorted(names, pairs[:2])], most)
            partial.append(np.unique(pairs[:2, ~keep]))
            pairs = pairs[:, keep]
        more = np.unique(np.concatenate(partial))
        for a, b in ((pairs[0], pairs[1]), (more, None)):
            for at in range(0, len(a), 1 << 16):
                own = a[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"a": pa.array(own), "b": pa.nulls(len(own), pa.int64()) if b is None else pa.array(b[at : at + (1 << 16)])})

    return run


def _told_on_pairs(variants):
    """What `variants` gives, with (a, null) told on the pairs of its node where it has any: (a, b, more_a, more_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(variants(batches))
        if not given:
            return
        table = pa.Table.from_batches(given)
        null = table["b"].is_null().to_numpy()
        a, b = table["a"].to_numpy(), table["b"].fill_null(0).to_numpy()
        more = a[null]
        kept = ~null | ~np.isin(a, np.r_[a[~null], b[~null]])
        a, b, null = a[kept], b[kept], null[kept]
        columns = {"a": pa.array(a), "b": pa.array(b, mask=null), "more_a": pa.array(np.isin(a, more)), "more_b": pa.array(np.isin(b, more) & ~null)}
        yield from pa.table(columns).to_batches(1 << 16)

    return run


def _halves(nodes: DataFrame, carried: list[str], segments: int, half: int) -> DataFrame:
    """A row for either half of every one of the first segments of nodes (node, label, segments, check, ...)."""
    rows = nodes.select(F.posexplode(F.slice("segments", 1, segments)).alias("i", "value"), *carried)
    low, high = F.col("value").bitwiseAND((1 << half) - 1), F.shiftright("value", half)
    name = lambda h: F.shiftleft(F.col("i").cast("long") * 2 + h, half)
    sides = F.array(F.struct((name(0) + high).alias("half"), low.alias("rest")), F.struct((name(1) + low).alias("half"), high.alias("rest")))
    return rows.select(F.inline(sides), *carried)


def _checked(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, text_col: str, sets: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are near. sets: tables of those made so far, to which this adds the missing ones."""
    files = splits(docs)
    end = lambda c: pairs.select(F.col(c).alias("node")).distinct()
    nodes = end("a").unionByName(end("b")).distinct()
    for made in sets:
        nodes = nodes.join(made.select("node"), "node", "left_anti")
    wanted = written(distinct.select("node", "told").join(nodes, "node"), "wanted", files)
    if not wanted.isEmpty():
        texts = docs.select(text_of(text_col).alias("text"), told_of(text_col).alias("told")).join(wanted, "told").groupBy("node").agg(F.first("text").alias("text"))

        def made(b: pa.RecordBatch) -> dict:
            return {"node": b.column("node"), "own": pa.array([shingles(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))}

        sets.append(written(arrow_map(texts, made, "node long, own array<long>"), "sets", files))
    if not sets:
        return pairs
    known = reduce(DataFrame.unionByName, sets)
    side = lambda c: known.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    common = F.size(F.array_intersect("own_a", "own_b"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.size("own_a") + F.size("own_b")))
    return written(near.select("a", "b"), "near", files)


def near_roots(docs: DataFrame, distinct: DataFrame, text_col: str = "text", shape: Shape = Shape(), per_part: int = 500_000) -> DataFrame:
    """(node, root) of the linked ones among distinct sets (node, told, segments, check, print); told: one text of each."""
    files, sets = splits(docs), []
    nodes, links, roots = distinct.withColumn("label", F.col("node")), None, None
    for turn, (segments, most) in enumerate(ROUNDS):
        segments = segments or shape.segments
        rows = _halves(nodes, ["node", "label", "check", *(["print"] if turn >= WITH_PRINT else [])], segments, shape.half)
        rows = rows.repartition(parts_for(distinct, nodes.count() * segments * 2, per_part), "half")
        found = written(rows.mapInArrow(tidy(_told_on_pairs(_variants(most, 32 * (turn % 2), shape))), "a long, b long, more_a boolean, more_b boolean"), "candidates", files)
        pairs = written(found.where("b is not null").select("a", "b").distinct(), "pairs", files)
        near = _checked(docs, distinct, pairs, text_col, sets)
        links = near if links is None else links.unionByName(near)
        roots = written(components(links, files), "roots", files)
        # After a round that has not looked at all segments, all go on.
        left = found.where("more_a").select(F.col("a").alias("node")).unionByName(found.where("more_b").select(F.col("b").alias("node"))).distinct()
        more = distinct if segments < shape.segments else distinct.join(left, "node")
        nodes = written(more.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "more", files)
        if nodes.isEmpty():
            break
    return roots


def near_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(told, root) of every text: texts of one root are near each other, or joined by texts that are."""
    shape, files = shape_of(docs.count()), splits(docs)
    rows = written(signed(docs, text_col, shape).dropDuplicates(["told"]), "signed", files)
    distinct = written(rows.groupBy("node").agg(F.min("told").alias("told"), F.first("segments").alias("segments"), F.first("check").alias("check"), F.first("print").alias("print")), "distinct", files)
    roots = near_roots(docs, distinct, text_col, shape)
    known = distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("told", "node").join(written(known, "known", files), "node").select("told", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that stay, one of each group: the one with the smallest id.

    What goes is told by row, not by id: see `one_of_each`."""
    return one_of_each(docs, near_groups(docs, text_col), id_col, text_col)
