"""Line dedup with two Bloom filters and an exact confirmation of suspects.

First scan: every line's key is hashed; a task sends each hash it has met once, or twice if two of its
documents hold it, as packed bytes to the hash's segment. A segment runs the hashes through its
once-seen filter; those that it has seen already go into its twice-seen filter. The twice-seen filters,
of at most `filter_bytes` together whatever the input, are given to all tasks. (With too many repeats
for that size they let more lines through, which costs shuffle and changes nothing in the result.)
Second scan: only lines that the twice-seen filters suspect are shuffled, by the SHA-256 of their key,
to find the first document of each and whether there is a second. Lines of later documents are dropped.

Nulls: a null text is one empty line; a null id sorts last and comes back as null. Rows that share an
id are one document for the counts, and each gets its own result. An empty table gives an empty result.
`dedup_rows` keeps any other columns of the table, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_of, key_of, small_batches, splits, text_of, tidy, written

HASHES = 4
BITS_EACH = 12
FLUSH = 2_000_000


def line_keys(text: str, least: int = 10) -> list[tuple[int, bytes]]:
    """(line number, key) of each line whose key has `least` code points."""
    out = []
    for i, line in enumerate(text.encode().lower().split(b"\n")):
        key = line.strip()
        n = len(key)
        if n >= least and (n >= 4 * least or len(key.decode()) >= least):
            out.append((i, key))
    return out


def _spots(hashes: np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(20)) | np.uint64(1)
    for i in range(HASHES):
        yield (a + np.uint64(i) * b) % np.uint64(bits) if np.isscalar(bits) else (a + np.uint64(i) * b) % bits


class Bloom:
    def __init__(self, bits: int):
        self.bits = bits
        self.flags = np.zeros(bits, bool)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _spots(hashes, self.bits):
            found &= self.flags[at]
        return found

    def add(self, hashes: np.ndarray) -> None:
        for at in _spots(hashes, self.bits):
            self.flags[at] = True


def _sized(n: int) -> int:
    return max(64, -(-n * BITS_EACH // 64) * 64)


def _hashes(docs: DataFrame, segments: int, least: int) -> DataFrame:
    """(segment, hashes): each distinct line hash of a task, twice if two of its documents hold it."""
    low = np.uint64(segments - 1)

    def packed(parts: list) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        found = np.concatenate([found, found[n > 1]])
        seg = found & low
        order = np.argsort(seg, kind="stable")
        found, seg = found[order], seg[order]
        names, starts = np.unique(seg, return_index=True)
        return pa.RecordBatch.from_pydict({"segment": pa.array(names.astype(np.int32)), "hashes": pa.array([x.tobytes() for x in np.split(found, starts[1:])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, mine, last = [], 0, set(), None
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {xxhash.xxh64_intdigest(k) for _, k in line_keys(text, least)}
                if own:
                    parts.append(np.fromiter(own, np.uint64, len(own)))
                    held += len(own)
            if held > FLUSH:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    return docs.select(key_of("__id").alias("key"), text_of("__text").alias("text")).mapInArrow(tidy(run), "segment int, hashes binary")


def _segment_filter(most_bits: int):
    def build(table: pa.Table) -> pa.Table:
        chunks = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        once, suspects = Bloom(_sized(sum(map(len, chunks)))), []
        for c in chunks:
            seen, n = np.unique(c, return_counts=True)
            suspects.append(seen[(n > 1) | once.has(seen)])
            once.add(seen)
        again = np.unique(np.concatenate(suspects))
        twice = Bloom(min(_sized(len(again)), most_bits) if len(again) else 64)
        twice.add(again)
        return pa.table({"segment": table.column("segment").slice(0, 1), "twice": pa.array([np.packbits(twice.flags).tobytes()], pa.binary())})

    return build


def _suspects(docs: DataFrame, given, segments: int, least: int) -> DataFrame:
    """(key, digest) of the lines that the twice-seen filters suspect, each once a document."""
    opened: dict = {}

    def suspected(b: pa.RecordBatch) -> dict:
        if not opened:
            sizes, start, flags = given.value
            opened["bits"], opened["start"] = np.frombuffer(sizes, np.uint64), np.frombuffer(start, np.uint64)
            opened["flags"] = np.unpackbits(np.frombuffer(flags, np.uint8)).view(bool)
        owners, lines, hashes = [], [], []
        for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = {k for _, k in line_keys(text, least)}
            owners += [key] * len(own)
            lines += own
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
        seg = (hashes & np.uint64(segments - 1)).astype(np.int64)
        bits, start = opened["bits"][seg], opened["start"][seg]
        hit = np.ones(len(lines), bool)
        for at in _spots(hashes, bits):
            hit &= opened["flags"][start + at]
        at = np.flatnonzero(hit)
        return {"key": pa.array([owners[i] for i in at], pa.int64()), "digest": pa.array([hashlib.sha256(lines[i]).digest() for i in at], pa.binary())}

    return arrow_map(docs.select(key_of("__id").alias("key"), text_of("__text").alias("text")), suspected, "key long, digest binary")


def later_lines(docs: DataFrame, least: int = 10, filter_bytes: int = 32 << 20) -> DataFrame:
    """(key, digests): for each document with any, the line keys that an earlier document holds.

    docs has columns __id and __text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.count()
    segments = 64
    while segments * 4096 < rows:
        segments *= 2
    built = _hashes(docs, segments, least).groupBy("segment").applyInArrow(_segment_filter(max(64, filter_bytes * 8 // segments)), "segment int, twice binary")
    sizes, start, flags = np.full(segments, 64, np.uint64), np.zeros(segments, np.uint64), [bytes(8)]
    at = 64  # segments without lines share the first, empty filter
    for r in built.collect():  # at most filter_bytes in all
        sizes[r.segment], start[r.segment] = len(r.twice) * 8, at
        flags.append(bytes(r.twice))
        at += len(r.twice) * 8
    given = spark.sparkContext.broadcast((sizes.tobytes(), start.tobytes(), b"".join(flags)))
    suspects = written(_suspects(docs, given, segments, least), "suspects")
    held = suspects.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    # The join reads scans on both sides, so that a very common line can be split at run time.
    later = suspects.join(written(held.select("digest", "first"), "repeated", splits(suspects)), "digest").where("key > first")
    return later.groupBy("key").agg(F.collect_set("digest").alias("digests"))


def _without(text: str, digests: list | None, least: int) -> tuple[int, int, str]:
    lines = text.split("\n")
    if not digests:
        return len(lines), 0, text
    gone = {bytes(d) for d in digests}
    drop = {i for i, k in line_keys(text, least) if hashlib.sha256(k).digest() in gone}
    return len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, filter_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for every row."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    drops = later_lines(base, least, filter_bytes)
    joined = base.select(key_of("__id").alias("key"), text_of("__text").alias("text")).join(drops, "key", "left").coalesce(splits(docs))

    def rebuilt(b: pa.RecordBatch) -> dict:
        out = [_without(t, d, least) for t, d in zip(b.column("text").to_pylist(), b.column("digests").to_pylist(), strict=True)]
        return {"key": b.column("key"), "n_lines": pa.array([x[0] for x in out], pa.int64()), "n_dropped": pa.array([x[1] for x in out], pa.int64()), "text": pa.array([x[2] for x in out], pa.string())}

    done = arrow_map(joined.select("key", "text", "digests"), rebuilt, "key long, n_lines long, n_dropped long, text string")
    return done.select(id_of("key").alias("doc_id"), "n_lines", "n_dropped", "text")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, filter_bytes: int = 32 << 20) -> DataFrame:
    """The table itself with later copies of lines taken out of its text; all its columns stay.

    Where nothing is dropped the text stays as it was, null included."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    drops = later_lines(base, least, filter_bytes)
    # Columns by position, as a table may hold any name.
    at, own = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    joined = docs.toDF(*own).join(drops, key_of(own[docs.columns.index(id_col)]) == F.col("key"), "left").drop("key").coalesce(splits(docs))
    gone = len(own)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not d or t is None else _without(t, d, least)[2] for t, d in zip(b.column(at).to_pylist(), b.column(gone).to_pylist(), strict=True)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(tidy(run), docs.schema)
