"""Benchmark decontamination: test suffixes looked up in suffix arrays of the training texts, shard by shard.

A task gathers whole documents to a shard of some million words, numbers the words that the test set
knows, and sorts the suffixes of the shard. The array is sparse: only suffixes that begin with the first
words of some test suffix (three, or as many as a short item has) are in it, as no other one can match.
Every test suffix is searched in it by binary search on its first ten words (a shorter item on all of it); the
range found holds all its places. Neighbouring places of consecutive test suffixes are one longest verbatim
match, so `matches` gives its start on both sides and its length. Words are compared whole, so nothing is
estimated. Documents are not shuffled; a document is never cut.

The test set is read in blocks of at most `block_bytes` of text (a longer single item is a block of its own); each
block is broadcast and all documents are scanned for it. With one block, the usual case, there is one scan.

Nulls: a null text has no words; an item without words occurs nowhere; one without an id is searched, but not
listed. Repeated rows, on either side, are rows of their own, repeated item ids are one item. A null document
id stays null. Empty tables: no documents give no rows, no items give rows without hits. Other columns of the
documents are kept by `drop_contaminated` whatever their names, and not read elsewhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, small_batches, splits, tidy, told_of, written
from .words import blocks, utf8, words

WINDOW = 10
#: Words of a suffix's beginning by which it comes into the sparse array.
FIRST = 3
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20


class Suffixes:
    """The suffixes of one block of the test set, by the words that are searched of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        #: Per length searched: the distinct beginnings in the order of their numbers, and where in which items each stands.
        self.starts: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        self.places: dict[int, list[list[tuple[int, int]]]] = defaultdict(list)
        self.ids = [None if i is None else str(i) for i, _ in items]
        for n, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text.encode() if text else None)]
            length = min(window, len(own))
            for at in range(len(own) - length + 1) if own else ():
                key = tuple(own[at : at + length])
                number = self.starts[length].setdefault(key, len(self.starts[length]))
                if number == len(self.places[length]):
                    self.places[length].append([])
                self.places[length][number].append((n, at))

    def searched(self) -> list[tuple[int, np.ndarray]]:
        """(length, numbers of the words searched) of every length."""
        return [(length, np.array(list(found), np.int32).reshape(-1, length)) for length, found in self.starts.items()]


def _keys(table: np.ndarray) -> np.ndarray:
    """A row of word numbers as one string of bytes that sorts as the row does."""
    return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * table.shape[1]}").ravel()


def _begins(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """For every place, its first n words as one number; 0 where a word is unknown or missing."""
    known = ids[: len(ids) - n + 1] > 0
    key = ids[: len(ids) - n + 1].astype(np.int64)
    for i in range(1, n):
        own = ids[i : len(ids) - n + 1 + i]
        known &= own > 0
        key = key * base + own
    key[~known] = 0
    return key


def found_in(ids: np.ndarray, suffixes: Suffixes, searched: list, first: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length: the places of a shard (word numbers, 0 between documents) where test suffixes match, and their numbers."""
    base, out, arrays = len(suffixes.vocabulary) + 1, {}, {}
    for length, table in searched:
        n = min(length, FIRST if base < 1 << 20 else 2)
        if len(ids) < length:
            continue
        if n not in arrays:
            if n not in first:
                tests = np.unique(np.concatenate([rows[:, :n].astype(np.int64) @ base ** np.arange(n - 1, -1, -1) for _, rows in searched if rows.shape[1] >= n]))
                flags = np.zeros(1 << 22, bool)
                flags[_spot(tests)] = True
                first[n] = tests, flags
            tests, flags = first[n]
            key = _begins(ids, n, base)
            at = np.flatnonzero(flags[_spot(key)] & (key > 0))
            at = at[tests[np.searchsorted(tests, key[at]).clip(max=len(tests) - 1)] == key[at]]
            # The suffix array: places in the order of their suffixes' first words.
            longest = max(x for x, _ in searched)
            padded = np.concatenate([ids, np.zeros(longest, np.int32)])
            own = _keys(padded[at[:, None] + np.arange(longest)]) if len(at) else np.empty(0, f"S{4 * longest}")
            order = np.argsort(own, kind="stable")
            arrays[n] = at[order], own[order]
        array, own = arrays[n]
        if not len(array):
            continue
        width = own.dtype.itemsize // 4
        low = np.searchsorted(own, _keys(np.pad(table, ((0, 0), (0, width - length)))))
        after = np.full((len(table), width), 0xFFFFFFFF, np.int64)
        after[:, :length] = table
        high = np.searchsorted(own, _keys(after), "right")
        size = high - low
        number = np.repeat(np.arange(len(table)), size)
        spot = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[length] = array[spot], number
    return out


def _spot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _shard(texts: list[bytes | None], suffixes: Suffixes, searched: list, first: dict) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]], list]:
    """Of every text: its number of words, the spans of words hit, the items that occur, and its places (length, place, number)."""
    number, parts, lengths = suffixes.vocabulary.get, [], []
    gap = np.zeros(1, np.int32)
    for text in texts:
        own = words(text)
        lengths.append(len(own))
        parts += [np.array([number(w, 0) for w in own], np.int32), gap]
    ids = np.concatenate(parts) if parts else gap
    starts = np.cumsum([0, *(n + 1 for n in lengths)])
    found = found_in(ids, suffixes, searched, first)
    edge = np.zeros(len(ids) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    places: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for length, (at, which) in found.items():
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        owner = np.searchsorted(starts, at, "right") - 1
        for d, w in np.unique(np.stack([owner, which]), axis=1).T.tolist():
            items[d].update(n for n, _ in suffixes.places[length][w])
        for d, a, w in zip(owner.tolist(), (at - starts[owner]).tolist(), which.tolist(), strict=True):
            places[d].append((length, a, w))
    hit = np.cumsum(edge)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return lengths, spans, items, places


def _longest(places: list[tuple[int, int, int]], suffixes: Suffixes) -> list[tuple[int, int, int, int]]:
    """(start in the document, item, start in the item, words) of the longest matches that these places make up."""
    at = {(length, a): w for length, a, w in places}
    out = []
    for length, a, w in sorted(places):
        for item, start in suffixes.places[length][w]:
            held = lambda i, own=(length, a, item, start): (own[2], own[3] + i) in suffixes.places[own[0]][at[own[0], own[1] + i]] if (own[0], own[1] + i) in at else False
            if not held(-1):
                n = 1
                while held(n):
                    n += 1
                out.append((a, item, start, length + n - 1))
    return sorted(out)


def _over_shards(docs: DataFrame, items: list[tuple], window: int, give, schema) -> DataFrame:
    """give(batches, shard result, suffixes) over shards of whole documents, whose last column is the text."""
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(Suffixes(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, first = given.value, {}
        searched, held, texts, size = suffixes.searched(), [], [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                texts += utf8(b.column(b.num_columns - 1))
                size += b.column(b.num_columns - 1).nbytes
                if size >= 6 * SHARD_WORDS:
                    yield from give(held, _shard(texts, suffixes, searched, first), suffixes)
                    held, texts, size = [], [], 0
        if held:
            yield from give(held, _shard(texts, suffixes, searched, first), suffixes)

    return docs.mapInArrow(tidy(run), schema)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SCHEMA = "key long, told long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _scanned(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    def give(held: list, shard: tuple, suffixes: Suffixes) -> Iterator[pa.RecordBatch]:
        lengths, spans, found, _ = shard
        at = 0
        for b in held:
            own = slice(at, at + b.num_rows)
            at += b.num_rows
            named = [sorted({suffixes.ids[i] for i in x} - {None}) for x in found[own]]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": b.column(0),
                    "told": b.column(1),
                    "n_words": pa.array(lengths[own], pa.int64()),
                    "spans": pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans[own]], SPANS),
                    "items": pa.array(named, pa.list_(pa.string())),
                }
            )

    return _over_shards(docs, items, window, give, _SCHEMA)


def _merged(parts: DataFrame) -> DataFrame:
    """Rows of several blocks as one row each: overlapping spans joined, items once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, items = [], []
            for s, x in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for start, stop in sorted((p["start"], p["stop"]) for p in s):
                    if joined and start <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], stop)
                    else:
                        joined.append([start, stop])
                spans.append([{"start": p, "stop": q} for p, q in joined])
                items.append(sorted(set(x)))
            columns = {n: b.column(n) for n in ("key", "told", "n_words")}
            yield pa.RecordBatch.from_pydict(columns | {"spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    gathered = parts.groupBy("key", "told").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return gathered.mapInArrow(tidy(run), _SCHEMA)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document row: the spans of words hit (start, stop after the last) and
    the ids, as strings in their order, of the items that occur in it."""
    rows = docs.select(key_of(id_col).alias("key"), told_of(text_col).alias("told"), F.col(text_col).alias("text"))
    parts = [_scanned(rows, block, window) for block in blocks(items, item_col, item_text_col, block_bytes)]
    out = parts[0]
    if len(parts) > 1:
        # A row for every document comes from the first block, from the others those that are hit.
        once = [written((p if n == 0 else p.where("size(spans) > 0")).dropDuplicates(["key", "told"]), "block", splits(docs)) for n, p in enumerate(parts)]
        told = written(_merged(reduce(DataFrame.unionByName, once)), "blocks", splits(docs))
        out = rows.select("key", "told").join(told, ["key", "told"])
    return out.select(id_of("key").alias("doc_id"), "n_words", "spans", "items")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, start, item, item_start, n_words): the longest verbatim matches of every document row, in words."""
    rows = docs.select(key_of(id_col).alias("key"), F.col(text_col).alias("text"))

    def give(held: list, shard: tuple, suffixes: Suffixes) -> Iterator[pa.RecordBatch]:
        keys = [k for b in held for k in b.column(0).to_pylist()]
        out = [(k, a, suffixes.ids[i], s, n) for k, p in zip(keys, shard[3], strict=True) if p for a, i, s, n in _longest(p, suffixes)]
        if out:
            key, start, item, item_start, n_words = zip(*out, strict=True)
            whole = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(key, whole), pa.array(start, whole), pa.array(item, pa.string()), pa.array(item_start, whole), pa.array(n_words, whole)], ["key", "start", "item", "item_start", "n_words"])

    out = None
    for block in blocks(items, item_col, item_text_col, block_bytes):
        part = _over_shards(rows, block, window, give, "key long, start long, item string, item_start long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out.select(id_of("key").alias("doc_id"), "start", "item", "item_start", "n_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of the documents in which no test suffix occurs, with all their columns."""
    names = docs.columns

    def give(held: list, shard: tuple, suffixes: Suffixes) -> Iterator[pa.RecordBatch]:
        clean = np.array([not s for s in shard[1]])
        at = 0
        for b in held:
            kept = b.filter(pa.array(clean[at : at + b.num_rows]))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))], names)

    last = "text"
    while last in names:
        last += "_"
    for block in blocks(items, item_col, item_text_col, block_bytes):
        # The text once more as the last column, where the scan looks for it.
        docs = _over_shards(docs.withColumn(last, F.col(text_col)), block, window, give, docs.schema)
    return docs
