"""An index of the keys of an append-only log, brought up to date by its new files only.

The index is a folder with three tables. `files`, the manifest, names the log files that are in it, with length and time;
`keys` has the distinct keys of each run, dealt to buckets by a hash; `filters` has a Bloom filter of each bucket of each
run. A restart lists the log, parses what the manifest lacks, adds keys and filters, and the manifest last: a run that
is lost before that leaves keys that the next one adds once more, which changes nothing. What is to be done is told by
the filters first, which are small; only what they suspect is joined with the keys, so the answer is exact.

A log file that has grown or changed since is read again. Nulls are no keys. An empty log gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _filesystem, exists, read_lines

BUCKETS = 64
BITS_EACH, HASHES = 12, 5


def _log_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time) of the files of a log, a file or a folder."""
    fs, own = _filesystem(spark, path)
    if not fs.exists(own):
        return []
    listed = fs.listStatus(own)
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter: HASHES rows."""
    own = hashes.view(np.uint64)
    step = (own >> np.uint64(33)) | np.uint64(1)
    return np.stack([((own + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)])


def _filter_of(frame: pd.DataFrame) -> pd.DataFrame:
    bits = max(64, len(frame) * BITS_EACH)
    flags = np.zeros(bits, bool)
    flags[_spots(frame["hash"].to_numpy(np.int64), bits)] = True
    return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "bits": [bits], "filter": [np.packbits(flags).tobytes()]})


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    told = F.xxhash64(F.col(key).cast("string"))
    return rows.withColumn("hash", told).withColumn("bucket", F.pmod(F.shiftright("hash", 48), F.lit(BUCKETS)).cast("int"))


def update(spark: SparkSession, log: str, index: str, keys_of: Callable[[DataFrame], DataFrame]) -> int:
    """Add the log files that the index does not know; how many there were.

    keys_of: lines (value) to their keys, one column."""
    known = set()
    if exists(spark, f"{index}/files"):
        known = {tuple(r) for r in spark.read.parquet(f"{index}/files").select("path", "length", "time").distinct().collect()}
    new = [f for f in _log_files(spark, log) if f not in known]
    if new:
        lines = read_lines(spark, [p for p, _, _ in new])
        keys = keys_of(lines)
        (name,) = keys.columns
        run = uuid.uuid4().hex
        own = _hashed(keys.where(F.col(name).isNotNull()).select(F.col(name).alias("key")).distinct(), "key")
        own.write.mode("append").parquet(f"{index}/keys/run={run}")
        kept = spark.read.parquet(f"{index}/keys/run={run}").select("bucket", "hash")
        # A task holds the keys of one bucket of the new files.
        filters = kept.groupBy("bucket").applyInPandas(_filter_of, "bucket int, bits long, filter binary")
        filters.write.mode("append").parquet(f"{index}/filters/run={run}")
        spark.createDataFrame(new, "path string, length long, time long").coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def left_to_do(todo: DataFrame, index: str, key: str) -> DataFrame:
    """The rows whose key the index does not hold; rows without a key are to do."""
    spark = todo.sparkSession
    if not exists(spark, f"{index}/files"):
        return todo
    names = todo.columns
    own = _hashed(todo.toDF(*(f"c{i}" for i in range(len(names)))), f"c{names.index(key)}")
    kind = dict(own.dtypes)[f"c{names.index(key)}"]
    filters, keys = spark.read.parquet(f"{index}/filters"), spark.read.parquet(f"{index}/keys").select("key")
    asked = own.where(f"c{names.index(key)} is not null").select(F.col(f"c{names.index(key)}").alias("key"), "hash", "bucket").distinct()

    def suspected(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(left), bool)
        for bits, packed in zip(right["bits"], right["filter"], strict=True) if len(left) else ():
            flags = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
            found |= flags[_spots(left["hash"].to_numpy(np.int64), int(bits))].all(axis=0)
        return left.loc[found, ["key"]]

    suspects = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(suspected, f"key {kind}")
    done = suspects.join(keys.select(F.col("key").cast(kind).alias("key")).distinct(), "key", "left_semi")
    left = own.join(done, F.col(f"c{names.index(key)}") == F.col("key"), "left_anti")
    return left.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
