"""Helpers that the operators share: the shared folder, written tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import written

#: Stands for a missing id, so that rows without one sort last and never get lost in a join.
NO_ID = (1 << 63) - 1
#: The white space of the contracts, `[\x20\x09-\x0D]`, as Python's bytes methods define it too.
BLANK = r"[\x20\x09-\x0D]"


def splits(df: DataFrame) -> int:
    """Tasks that read df: for a table, a measure of its size. (What is still to be shuffled runs for this.)"""
    return max(1, df.rdd.getNumPartitions())


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_of(key: str | Column) -> Column:
    """The id again; null where it was missing."""
    return F.nullif(F.col(key) if isinstance(key, str) else key, F.lit(NO_ID))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def told_of(text_col: str) -> Column:
    """Tells texts apart: rows of one id and one text are the same row, repeated."""
    return F.xxhash64(text_of(text_col))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay, one of each of groups (told, root): the one with the smallest id.

    Repeats of that row stay too, if it has an id. Of a repeated id, only rows in other rows' groups go;
    rows without an id sort last and are rows of their own."""
    rows = docs.select(key_of(id_col).alias("key"), told_of(text_col).alias("told")).distinct()
    rows = written(written(rows, "rows", splits(docs)).join(written(groups, "groups", splits(docs)), "told"), "grouped", splits(docs))
    first = written(rows.groupBy("root").agg(F.min(F.struct("key", "told")).alias("first")), "firsts", splits(docs))
    gone = written(rows.join(first, "root").where("struct(key, told) <> first").select("key", "told"), "gone", splits(docs))
    # Columns by position, as a table may hold any name.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    marked = docs.toDF(*names).withColumn("key", key_of(own_id)).withColumn("told", told_of(own_text))

    def left(rows: DataFrame) -> DataFrame:
        return rows.join(gone, ["key", "told"], "left_anti")

    named, unnamed = left(marked.where(F.col(own_id).isNotNull())), left(marked.where(F.col(own_id).isNull()))
    return named.unionByName(unnamed.dropDuplicates(["told"])).select(*names).toDF(*docs.columns)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives the memory it has used back to the machine at its end: workers outlive tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow for a function from one batch to a dict of columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return df.mapInArrow(tidy(run), schema)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches that stay small where rows are whole texts: by rows, and by bytes for long ones.

    For the session from here on, and only downwards in rows: a plan reads these settings when it runs, which
    may be long after it was made, so they cannot be put back."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions that hold about per_part of so many rows each, at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_part))
