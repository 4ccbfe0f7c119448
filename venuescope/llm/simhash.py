"""SimHash near duplicates by deletion-variant signatures.

Two 64-bit fingerprints within three bits differ by at most one bit in one of their two halves. So each
half is indexed 32 times, each time with another bit as a wildcard: fingerprints that agree in such a
variant meet, and are verified on all 64 bits. Equal fingerprints are merged before that. Where many
fingerprints share a variant, the task that holds it keeps a spanning forest of the verified links, not
all pairs; a very large variant is cut by the bytes of the other half, of which one must be equal.

Nulls: a null text has no words and the fingerprint zero; a null id sorts last and comes back as null.
Repeated rows of one id share its fingerprint. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, id_of, key_of, parts_for, small_batches, splits, text_of, tidy, written
from .components import components

SEED = 42
LARGE = 4096


def fingerprint(text: str, width: int = 3) -> int:
    """Majority bits of the XXH64 of every shingle of `width` words, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    total, bits = len(shingles), np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, total)
    for at in range(0, total, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long."""
    small_batches(docs.sparkSession)

    def made(b: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        return {"key": b.column("key"), "fp": pa.array(fps.view(np.int64))}

    return arrow_map(docs.select(key_of(id_col).alias("key"), text_of(text_col).alias("text")), made, "key long, fp long")


def forest(fps: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of links that join all fingerprints reachable over links of at most `bits` bits."""
    ends_a, ends_b = [], []
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= bits
            if near.any():
                got = left[near]
                ends_a.append(np.full(len(got), x))
                ends_b.append(got)
                front.extend(got)
                left = left[~near]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *ends_a]), np.concatenate([none, *ends_b])


def _large(fps: np.ndarray, half: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A large variant of half `half` (0 the low one): cut by each byte of the other half."""
    for byte in range(4):
        value = (fps >> np.uint64(32 * (1 - half) + 8 * byte)) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            a, b = forest(fps[part], bits)
            yield part[a], part[b]


def _links(bits: int):
    """Links of a partition of variants (variant, fp, first), each partition holding whole variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("variant", "fp", "first")] for b in batches if b.num_rows]
        if not parts:
            return
        variant, fp, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp = fp.view(np.uint64)
        order = np.argsort(variant, kind="stable")
        variant, fp, first = variant[order], fp[order], first[order]
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        lengths = np.diff(np.r_[starts, len(variant)])
        two = starts[lengths == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        found = [np.stack([first[two], first[two + 1]])]
        for s, n in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            own, ids = fp[s : s + n], first[s : s + n]
            for a, b in _large(own, int(variant[s]) >> 37, bits) if n > LARGE else [forest(own, bits)]:
                found.append(np.stack([ids[a], ids[b]]))
        pairs = np.sort(np.concatenate(found, axis=1), axis=0)
        pairs = np.unique(pairs, axis=1)
        if pairs.size:
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return run


def links(distinct: DataFrame, bits: int = 3, per_part: int = 500_000) -> DataFrame:
    """Links (a, b) between the firsts of distinct fingerprints (fp, first) within `bits` of each other."""
    if bits > 3:
        raise ValueError("two halves with one wildcard find at most three bits")
    halves = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]
    variants = [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))) + F.lit((s << 37) | (j << 32)) for s, half in enumerate(halves) for j in range(32)]
    rows = distinct.select(F.explode(F.array(*variants)).alias("variant"), "fp", "first")
    return rows.repartition(parts_for(distinct, distinct.count() * 64, per_part), "variant").mapInArrow(tidy(_links(bits)), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id (smallest id reachable over links) of every row."""
    all_fps = written(fingerprints(docs, id_col, text_col, width), "fps")
    files = splits(docs)
    distinct = written(all_fps.groupBy("fp").agg(F.min("key").alias("first")), "distinct", files)
    roots = components(links(distinct, bits), files)
    known = distinct.join(roots, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("root", "first").alias("component"))
    joined = all_fps.join(written(known, "known", files), "fp")
    return joined.select(id_of("key").alias("doc_id"), "fp", id_of("component").alias("component_id"))


__all__ = ["NO_ID", "fingerprint", "fingerprints", "forest", "links", "simhash_groups"]
