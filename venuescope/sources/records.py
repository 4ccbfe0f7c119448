"""Quoted CSV read in byte ranges: the records of files whose quoted texts may hold line ends.

Spark hands out physical lines by byte ranges of the files. Whether a range starts inside a quoted text depends on all
before it, so the first pass runs every range from both states, outside and inside quotes, and gives the state each ends
in, whether a record starts in it, and the pieces of records that reach over its ends. Only the states, one row a range,
come to the driver, where they are combined in the order of the ranges. With the true state of each range the second
pass cuts the ranges into records on its own; the pieces are put together by the range in which their record starts.

Text goes through as bytes: in UTF-8 and the Korean code page no byte of a longer character is a quote, a comma or a
line end. A doubled quote, or one after the escape character, does not end a quoted text; after its end, all up to the
next comma belongs to the field; a quote within an unquoted field is a character like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import written

#: Ranges whose states are combined on the driver at a time; more are read as several groups of files.
MOST_RANGES = 100_000
OUTSIDE, INSIDE = 0, 1


def after(line: bytes, state: int, escape: bytes) -> int:
    """The state at the end of a line that starts in this one."""
    at = 0
    while True:
        if state == OUTSIDE:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return OUTSIDE
                continue
            at += 1
        while True:
            end = line.find(b'"', at)
            if escape != b'"':
                slash = line.find(escape, at, end if end >= 0 else len(line))
                if slash >= 0:
                    at = slash + 2
                    continue
            elif end >= 0 and line[end + 1 : end + 2] == b'"':
                at = end + 2
                continue
            break
        if end < 0:
            return INSIDE
        at = line.find(b",", end + 1) + 1
        if not at:
            return OUTSIDE
        state = OUTSIDE


class Cutter:
    """Cuts the lines of one range, given batch by batch, into records."""

    def __init__(self, state: int, escape: bytes):
        self.state, self.escape, self.head, self.open, self.lines, self.last = state, escape, [], [], 0, 0
        self.started = False

    def records(self, lines: pa.Array) -> list[bytes]:
        """The records that end in these lines; the first of the range, if it starts inside, goes to `head`."""
        quoted = np.flatnonzero(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) > 0).tolist()
        own, out, at = lines.to_pylist(), [], 0
        for i in [*quoted, len(own)]:
            # Up to the next line with quotes the state does not change.
            if self.state == OUTSIDE:
                if at < i:
                    self._start(at)
                    out += own[at:i]
            else:
                self._piece(own[at:i])
            if i < len(own):
                was, self.state = self.state, after(own[i], self.state, self.escape)
                if was == OUTSIDE:
                    self._start(i)
                    self.open = []
                self._piece(own[i : i + 1])
                if self.state == OUTSIDE:
                    if self.started and self.open:
                        out.append(b"\n".join(self.open))
                    self.open = []
            at = i + 1
        self.lines += len(own)
        return out

    def _start(self, at: int) -> None:
        self.started = True
        self.last = self.lines + at

    def _piece(self, lines: list[bytes]) -> None:
        (self.open if self.started else self.head).extend(lines)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((path, start), lines) of the ranges of a task, in their order."""
    for b in batches:
        path, start = b.column("path"), b.column("start").to_numpy()
        edges = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if b.num_rows else []
        names = path.to_pylist() if b.num_rows else []
        cuts = sorted({*map(int, edges), *(i for i in range(1, len(names)) if names[i] != names[i - 1])})
        for low, high in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            yield (names[low], int(start[low])), b.column("value").slice(low, high - low)


def _lines(spark: SparkSession, files: list[str], line_end: str) -> DataFrame:
    rows = spark.read.option("lineSep", line_end).text(files)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


_SUMMARY = "path string, start long, end0 int, end1 int, has0 boolean, has1 boolean, head binary, tail0 binary, tail1 binary, only0 boolean"


def _summaries(lines: DataFrame, escape: bytes) -> DataFrame:
    """A row for every range: its end under both states, whether a record starts in it, and the pieces at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both = None, []

        def told() -> pa.RecordBatch:
            a, b = both
            tail = lambda c: b"\n".join(c.open) if c.started and c.state == INSIDE else None
            row = {"path": now[0], "start": now[1], "end0": a.state, "end1": b.state, "has0": a.started, "has1": b.started, "head": b"\n".join(b.head), "tail0": tail(a), "tail1": tail(b), "only0": a.last == 0}
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for name, own in _ranges(batches):
            if name != now:
                if now:
                    yield told()
                now, both = name, [Cutter(OUTSIDE, escape), Cutter(INSIDE, escape)]
            for c in both:
                c.records(own)
        if now:
            yield told()

    return lines.mapInArrow(run, _SUMMARY)


def _states(ranges: list) -> dict[tuple[str, int], int]:
    """Of every range that starts inside quotes, the start of the range in which that text's record starts."""
    out, path, state, owner = {}, None, OUTSIDE, 0
    for r in sorted(ranges, key=lambda r: (r.path, r.start)):
        if r.path != path:
            path, state, owner = r.path, OUTSIDE, 0
        if state == INSIDE:
            out[r.path, r.start] = owner
        owner = r.start if (r.has0, r.has1)[state] else owner
        state = (r.end0, r.end1)[state]
    return out


def csv_records(spark: SparkSession, files: list[str], escape: str = '"', line_end: str = "\n") -> DataFrame:
    """(record, first): the records of the files as bytes without their line end; first: whether it is its file's first."""
    mark, lines = escape.encode(), _lines(spark, files, line_end)
    ranges = written(_summaries(lines, mark), "csv-ranges")
    inside = _states(ranges.select("path", "start", "end0", "end1", "has0", "has1").collect())
    given = spark.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, None
        for name, own in _ranges(batches):
            if name != now:
                now, cutter = name, Cutter(INSIDE if name in given.value else OUTSIDE, mark)
                head = now[1] == 0
            out = cutter.records(own)
            if out:
                first = np.zeros(len(out), bool)
                first[0] = head
                head = False
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary()), "first": pa.array(first)})
            # A first record that is still open reaches into the next batch or range.

    whole = lines.mapInArrow(run, "record binary, first boolean")
    owners = spark.createDataFrame([(p, s, o) for (p, s), o in inside.items()], "path string, start long, owner long")
    told = ranges.join(owners, ["path", "start"], "left")
    heads = told.where("owner is not null").select("path", "owner", F.col("start").alias("at"), F.col("head").alias("piece"), F.lit(False).alias("only"))
    tail = F.when(F.col("owner").isNull(), F.col("tail0")).otherwise(F.col("tail1"))
    tails = told.select("path", F.col("start").alias("owner"), F.col("start").alias("at"), tail.alias("piece"), (F.col("owner").isNull() & F.col("only0") & (F.col("start") == 0)).alias("only")).where("piece is not null")
    pieces = heads.unionByName(tails).groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.max("only").alias("first"))
    end = F.lit(b"\n")
    joined = F.aggregate(F.slice("pieces", 2, 1 << 30), F.col("pieces")[0]["piece"], lambda text, p: F.concat(text, end, p["piece"]))
    return whole.unionByName(pieces.select(joined.alias("record"), "first"))


def in_groups(sizes: dict[str, int], per_range: int, most: int = MOST_RANGES) -> list[list[str]]:
    """Files in groups of at most so many ranges, in their order; a larger file is a group of its own."""
    out, held = [[]], 0
    for path, size in sizes.items():
        own = size // per_range + 2
        if out[-1] and held + own > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += own
    return out
