"""Vectors: blends, and an encoder without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..constants import BLEND_CUT, BLEND_SENTIMENT, BLEND_SIMILARITY, KEYWORD_COPIES, MINUTES_COPIES


def blended(similarity: Column, sentiment: Column) -> Column:
    """Similarity, cut to 0 to 1, and sentiment together; null at or under the threshold."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    return F.when(own > BLEND_CUT, BLEND_SIMILARITY * own + BLEND_SENTIMENT * sentiment)


def boosted(total: Column, n: Column, keyword: Column, minutes: Column, keyword_copies: int = KEYWORD_COPIES, minutes_copies: int = MINUTES_COPIES) -> Column:
    """A mean in which boosts count as so many further values; null without any value."""
    k, m = F.when(keyword.isNotNull(), keyword_copies).otherwise(0), F.when(minutes.isNotNull(), minutes_copies).otherwise(0)
    return F.try_divide(F.coalesce(total, F.lit(0.0)) + k * F.coalesce(keyword, F.lit(0.0)) + m * F.coalesce(minutes, F.lit(0.0)), F.coalesce(n, F.lit(0)) + k + m)


def keyword_boost(hits: Column) -> Column:
    return F.when(hits > 0, F.least(0.75 + 0.05 * hits, F.lit(0.95)))


#: The length of hashed vectors, and the sizes of their n-grams.
BUCKETS, LEAST, MOST = 4096, 2, 5
#: Texts whose vectors are held at a time, characters whose n-grams are looked up at a time, and bits of a slot's number
#: in a worker's memory of the n-grams of one size.
ENCODED, LOOKED_UP, SLOT_BITS = 128, 1 << 16, 20


def _bucket(gram: str, buckets: int = BUCKETS) -> int:
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[8:], "big") % buckets


def hash_vector(text: str, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Counts of the character n-grams of padded words by hash, at length 1."""
    out = np.zeros(buckets)
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(least, most + 1):
            for i in range(max(1, len(padded) - n + 1)):
                out[_bucket(padded[i : i + n], buckets)] += 1
            if len(padded) <= n:
                break
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


class _Remembered:
    """The buckets of n-grams of one size. A slot holds the n-gram that came to it last, with all its characters (three a
    number), so the memory is of one size whatever the texts, and never takes an n-gram for another."""

    def __init__(self, n: int):
        self.n = n
        self.keys = [np.full(1 << SLOT_BITS, -1, np.int64).view(np.uint64) for _ in range(0, n, 3)]
        self.found = np.zeros(1 << SLOT_BITS, np.int32)

    def buckets(self, text: str, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The buckets of the n-grams that begin at these places of a text, which is given by its code points too."""
        n, size = self.n, len(codes) - self.n + 1
        keys = [sum(codes[i : i + size] << np.uint64(21 * (i - j)) for i in range(j, min(j + 3, n)))[at] for j in range(0, n, 3)]
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for key in keys[1:]:
            mixed = (mixed ^ key) * np.uint64(0xC2B2AE3D27D4EB4F)
        slots = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out, strange = self.found[slots], np.zeros(len(slots), bool)
        for own, key in zip(self.keys, keys, strict=True):
            strange |= own[slots] != key
        new = np.flatnonzero(strange)
        if len(new):
            new = new[np.lexsort([key[new] for key in keys])]
            first = np.ones(len(new), bool)
            first[1:] = np.any([key[new[1:]] != key[new[:-1]] for key in keys], axis=0)
            once = new[first]
            told = np.array([_bucket(text[i : i + n]) for i in at[once].tolist()], np.int32)
            out[new] = told[np.cumsum(first) - 1]
            for own, key in zip(self.keys, keys, strict=True):
                own[slots[once]] = key[once]
            self.found[slots[once]] = told  # of several that come to one slot, the last one stays in all its parts
        return out


_remembered = cache(_Remembered)


def hash_matrix(texts: list[str], kind: type = np.float32) -> np.ndarray:
    """The hashed vectors of texts, one a row. The n-grams of many texts are looked up together, and only those that the
    worker does not remember are hashed."""
    padded = ["".join([f" {word}" for word in text.lower().split()]) for text in texts]
    # The blank after a word is the one before the next, of the same text or another.
    joined = "".join(padded) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(texts)) * BUCKETS, [len(p) for p in padded])
    counts = np.zeros(len(texts) * BUCKETS)
    for start in range(0, len(rows), LOOKED_UP):
        stop = start + LOOKED_UP
        text, own, row = joined[start : stop + MOST - 1], codes[start : stop + MOST - 1].astype(np.uint64), rows[start:stop]
        blank, within, found = own == 32, np.ones(len(row), bool), []
        for n in range(LEAST, MOST + 1):
            within = within[: len(own) - n + 1]
            if n > 2:  # no blank but at an end
                within = within & ~blank[n - 2 : n - 2 + len(within)]
            at = np.flatnonzero(within)
            if not len(at):
                break
            found.append(row[at] + _remembered(n).buckets(text, own, at))
        told = np.bincount(np.concatenate(found) - row[0])
        counts[row[0] : row[0] + len(told)] += told
    counts = counts.reshape(len(texts), BUCKETS)
    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
    return np.divide(counts, norm, out=np.zeros(counts.shape, kind), where=norm > 0, casting="same_kind")


def _in_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Batches of few texts: a vector may be far larger than its text, so a batch of vectors is bounded by their number."""
    for batch in batches:
        for at in range(0, len(batch), ENCODED):
            yield batch.iloc[at : at + ENCODED]


@F.pandas_udf(ArrayType(FloatType()))
def hash_encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Vectors for text where no sentence model is at hand."""
    for part in _in_parts(batches):
        yield pd.Series(list(hash_matrix(part.fillna("").tolist())))


@F.arrow_udf(ArrayType(FloatType()))
def hash_encoded_arrow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same for many texts: of a pandas result PySpark makes a Python object for every number."""
    for batch in batches:
        for at in range(0, len(batch), ENCODED):
            found = hash_matrix([t or "" for t in batch.slice(at, ENCODED).to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BUCKETS), pa.array(found.reshape(-1)))


def encoder(candidates: list[Callable[[], Callable[[list[str]], np.ndarray]]]):
    """An Arrow function from text to vector by the first of the candidates that loads, once per task; by
    hashing where none does. A candidate loads a model: texts to rows of numbers."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = first_that_loads(candidates)
        for part in _in_parts(batches):
            yield pd.Series([np.asarray(v, np.float32) for v in model(part.fillna("").tolist())])

    return encode


def first_that_loads(candidates: list[Callable]) -> Callable[[list[str]], list]:
    for load in candidates:
        try:
            return load()
        except (ImportError, OSError, RuntimeError, ValueError):  # a model that is not there
            continue
    return lambda texts: list(hash_matrix(texts, np.float64))


def gram_counts(text: str, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The character n-grams of a text (of up to three characters), each packed into a number, ascending, and their counts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = max(0, len(codes) - size + 1)
    return np.unique(sum(codes[i : i + n] << 21 * i for i in range(size)), return_counts=True)


def added_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of two texts together."""
    grams, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.zeros(len(grams), np.int64)
    np.add.at(out, at, np.concatenate([a[1], b[1]]))
    return grams, out
