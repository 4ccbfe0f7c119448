"""Readers and writers of review files."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .html import fields
from .records import csv_records, in_groups

#: The column that holds a broken row's line while files are read.
BROKEN = "__broken"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _filesystem(spark, path)
    return fs.exists(own)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def _files(spark: SparkSession, path: str) -> list[str]:
    fs, own = _filesystem(spark, path)
    if not fs.getFileStatus(own).isDirectory():
        return [path]
    return [s.getPath().toString() for s in fs.listStatus(own) if not s.getPath().getName().startswith(("_", "."))]


def encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """The encoding of every file of a path: UTF-8 where all its bytes are valid, else the Korean code page.

    All bytes are looked at, by the executors and by line; only the files' names come back."""
    files = _files(spark, path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    lines = spark.read.text(files).select(name.alias("file"), F.is_valid_utf8("value").alias("valid"))
    other = {r.file for r in lines.where("not valid").select("file").distinct().collect()}
    # Names come back escaped as in addresses.
    return {f: "x-windows-949" if quote(f.rsplit("/", 1)[-1]) in other or f.rsplit("/", 1)[-1] in other else "UTF-8" for f in files}


def _csv(spark: SparkSession, encoding: str, escape: str) -> DataFrameReader:
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", escape).option("encoding", encoding).option("mode", "PERMISSIVE").option("nullValue", "\x00").option("emptyValue", "")


def _in_one_task(spark: SparkSession, files: list[str], names: list[str], encoding: str, escape: str) -> DataFrame:
    """The rows of files by Spark's own reader for quoted line ends, which gives every file to one task."""
    schema = StructType([StructField(n, StringType()) for n in [*names, BROKEN]])
    rows = _csv(spark, encoding, escape).schema(schema).option("columnNameOfCorruptRecord", BROKEN).option("enforceSchema", True).csv(files)
    told = [f"c{i}" for i in range(len(rows.columns))]
    again = F.from_csv(BROKEN, ", ".join(f"`{n}` string" for n in told), _options(escape))
    return rows.withColumn(BROKEN, F.when(again[told[-1]].isNotNull(), F.col(BROKEN)))


def _options(escape: str) -> dict[str, str]:
    return {"quote": '"', "escape": escape, "nullValue": "\x00", "emptyValue": ""}


def _line_end(spark: SparkSession, path: str) -> str:
    """Line feeds, if one comes before a carriage return that stands alone; else such carriage returns."""
    first = spark.read.option("lineSep", "\n").text(path).select(F.substring(F.col("value"), 1, 1 << 20)).limit(1).collect()
    return "\r" if first and "\r" in first[0][0][:-1] else "\n"


def _in_ranges(spark: SparkSession, files: list[str], names: list[str], encoding: str, escape: str) -> DataFrame:
    """The rows of files cut into byte ranges that are read on their own."""
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    by: dict[str, list[str]] = {}
    for f in files:
        by.setdefault(_line_end(spark, f), []).append(f)
    per_range = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    parts = []
    for end, own in by.items():
        for group in in_groups({f: _size(spark, f) for f in own}, per_range):
            records = csv_records(spark, group, escape, end).where("not first")
            text = F.col("record").cast("string") if encoding == "UTF-8" else F.decode("record", encoding)
            # Where lines end in two characters, such an end within a text is one line feed.
            plain = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
            rows = records.select(text.alias("text")).select(F.when(F.col("text").endswith("\r"), plain).otherwise(F.col("text")).alias("text")).where("text <> ''")
            told = [f"c{i}" for i in range(len(names) + 1)]
            fields = rows.select(F.from_csv("text", ", ".join(f"{n} string" for n in told), _options(escape)).alias("f"), "text")
            named = [F.col(f"f.c{i}").alias(n) for i, n in enumerate(names)]
            parts.append(fields.select(*named, F.when(F.col(f"f.{told[-1]}").isNotNull(), F.col("text")).alias(BROKEN)))
    return reduce(DataFrame.unionByName, parts)


def _size(spark: SparkSession, path: str) -> int:
    fs, own = _filesystem(spark, path)
    return fs.getFileStatus(own).getLen()


def _parsed(spark: SparkSession, path: str, encoding: str | None, escape: str, split: bool) -> DataFrame:
    """All rows of the files with `_broken`, the line of a row that has more fields than the header."""
    by: dict[str, list[str]] = {}
    for f, e in (encodings(spark, path) if encoding is None else dict.fromkeys(_files(spark, path), encoding)).items():
        by.setdefault(e, []).append(f)
    out = None
    for e, files in sorted(by.items()):
        names = _csv(spark, e, escape).csv(files).columns
        part = (_in_ranges if split else _in_one_task)(spark, files, names, e, escape)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str | None = None, escape: str = '"', split: bool = True) -> DataFrame:
    """CSV files with a header, all columns strings: quoted texts may hold line ends, delimiters and quotes.

    Files are read in byte ranges, so that one large file keeps many tasks busy (`records.csv_records`); with
    split=False each is read by one task. Quotes inside quotes are doubled; `escape="\\\\"` reads files that write
    them after a backslash. A row with too few fields ends in nulls; one with too many is left out, see
    `broken_rows`. The encoding of each file is found by looking at all of it, unless given. Rows of a file of one
    range come in its order; those of several ranges in no order (a record over a range's end comes last)."""
    rows = _parsed(spark, path, encoding, escape, split)
    kept = rows.where(F.col(BROKEN).isNull()).drop(BROKEN)
    return kept.select(*columns) if columns else kept


def broken_rows(spark: SparkSession, path: str, encoding: str | None = None, escape: str = '"', split: bool = True) -> DataFrame:
    """The rows that `read_csv` leaves out, as they stand in the file (line)."""
    rows = _parsed(spark, path, encoding, escape, split)
    # The one-task reader does not give broken lines alone: a condition that always holds reads the columns too.
    read = F.length(F.concat_ws("", *(c for c in rows.columns if c != BROKEN))) >= 0
    return rows.where(read & F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def read_parts(spark: SparkSession, paths: list[str], order: tuple[str, ...] = ("review_index", "place")) -> DataFrame:
    """Several files as one table, in the order of the first of the columns that exists."""
    df = read_csv(spark, paths[0])
    for p in paths[1:]:
        df = df.unionByName(read_csv(spark, p), allowMissingColumns=True)
    by = next((c for c in order if c in df.columns), None)
    return df.orderBy(F.col(by).try_cast("long"), by) if by else df


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, of a log that may hold broken ones."""
    return spark.read.text(path).where(F.regexp_replace("value", r"\s+", "") != "")


def read_json_config(spark: SparkSession, path: str) -> dict:
    return spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)


def write_csv(df: DataFrame, path: str, suffix: str = "", bom: bool = False) -> str:
    """A folder of CSV files with a header; with `bom` the first column's name carries the mark for spreadsheets."""
    target = f"{path}{suffix}"
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    # Without these two, the writer trims texts.
    plain = df.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    plain.option("header", True).option("escape", '"').csv(target)
    return target


def write_scores(tables: dict[str, DataFrame], folder: str, prefix: str, suffix: str = "") -> dict[str, str]:
    """One output per table, named by prefix and table."""
    return {name: write_csv(df, f"{folder}/{prefix}_{name}", suffix) for name, df in tables.items()}


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to a log folder."""
    df.write.mode("append").json(path)


def done_reviews(lines: DataFrame) -> DataFrame:
    """review_index of every answer in a log."""
    answers = lines.select(F.from_json("value", "reviews array<struct<review_index:string>>").alias("a")).where("a is not null")
    return answers.select(F.explode("a.reviews.review_index").alias("r")).select(F.col("r").try_cast("long").alias("review_index")).where("review_index is not null").distinct()


def remembered(spark: SparkSession, folder: str, make: Callable[..., DataFrame], *args: object, version: str = "1", seconds: float | None = None, now: Callable[[], float] = time.time) -> DataFrame:
    """The table that make(*args) gives, worked out once for each version and arguments and then read.

    seconds: how long a table lasts; time is cut into spans of that length, each with a table of its own, so
    that one that is being read is never replaced."""
    span = int(now() // seconds) if seconds else None
    key = hashlib.sha1(repr((make.__name__, version, args, span)).encode()).hexdigest()
    path = f"{folder}/{make.__name__}-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make(*args).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Where a page tells its title, heading and language, the first selector that has a text.
PAGE_FIELDS = {"title": ["title", 'meta[property="og:title"]@content'], "heading": ["h1", "title"], "page_lang": ["html@lang", "[lang]@lang"]}


def html_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, heading and language of pages, as they are written, and the numbers of links and paragraphs."""
    return fields(pages, PAGE_FIELDS, html, {"links": "a", "paragraphs": "p"}, as_written=True)


def rating_of(label):
    """The stars in a label such as "Rated 4 of 5"."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def point_of(url):
    """(lat, lng) after an @ in a map's address."""
    part = lambda i: F.regexp_extract(url, r"@(-?\d+\.\d+),(-?\d+\.\d+)", i).try_cast("double")
    return F.when(url.rlike(r"@-?\d+\.\d+,-?\d+\.\d+"), F.struct(part(1).alias("lat"), part(2).alias("lng")))
