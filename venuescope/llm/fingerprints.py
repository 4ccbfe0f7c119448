"""Document fingerprints: threshold-scaled sketches of five-word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash space, and at least the `least`
smallest hashes, so that short texts keep enough of them. Sketches merge by union (cut again to the same
rule) and two of them are compared below the smaller of the values up to which each is complete: that
gives the likeness (shared part of the union) and the containment (shared part of one side), also of
texts of very unequal length. A sketch's size follows its text's: about `fraction` of its shingles.

The next document by id is found without a global sort: the ids from least to largest, dense or not, are
cut into at most 2^18 ranges, each range is ordered on its own, and the first row of a range is also handed
to the range before it. Only the ranges themselves are ordered in one task. Rows without an id have 64
ranges of their own, by the hash of their text.

Nulls: a null text is an empty one, without shingles; two such texts are alike (1), one such and another
not (0). A text of fewer than five words is one shingle. A null id sorts last and comes back as null.
Repeated rows of one id, and those without one, follow each other by the hash of their text and then by
text; those of one id are ordered in one task. An empty table gives an empty result; with one row, that row
is its own next. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, id_of, key_of, text_of, written

WORDS = 5
FRACTION = 1 / 8
LEAST = 32
#: Rows that a range is made for, the most ranges, and the most quantiles of the ids that they follow.
PER_RANGE, MOST_RANGES, SPLITTERS = 512, 1 << 18, 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """63-bit hashes of all shingles of `width` words."""

    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(width))), 1))
        few = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 1))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(text), hashed)


def _bound(fraction: float) -> int:
    return int(fraction * (1 << 63))


def cut(hashes: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of a set of hashes: those under the fraction, and at least the `least` smallest."""

    def of(all_hashes: Column) -> Column:
        low = F.array_distinct(F.filter(all_hashes, lambda h: h < F.lit(_bound(fraction))))
        return let(low, lambda x: F.when(F.size(x) >= least, F.sort_array(x)).otherwise(F.slice(F.sort_array(F.array_distinct(all_hashes)), 1, least)))

    return let(hashes, of)


def sketch(text: Column, fraction: float = FRACTION, least: int = LEAST, width: int = WORDS) -> Column:
    return cut(shingle_hashes(text, width), fraction, least)


def merged(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    return cut(F.concat(a, b), fraction, least)


def _complete(s: Column, fraction: float, least: int) -> Column:
    """All hashes under this value are in the sketch."""
    last = F.try_element_at(s, F.lit(-1))
    return F.when(F.size(s) < least, F.lit((1 << 63) - 1)).when(last < F.lit(_bound(fraction)), F.lit(_bound(fraction))).otherwise(last + 1)


def _compared(a: Column, b: Column, fraction: float, least: int, ratio: Callable[[Column, Column, Column], Column]) -> Column:
    def under(bound: Column) -> Column:
        x, y = F.filter(a, lambda h: h < bound), F.filter(b, lambda h: h < bound)
        return ratio(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))

    same = F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
    return same.otherwise(let(F.least(_complete(a, fraction, least), _complete(b, fraction, least)), under))


def likeness(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated share of all shingles of either text that both hold."""
    return _compared(a, b, fraction, least, lambda n, x, y: F.coalesce(F.try_divide(n, x + y - n), F.lit(0.0)))


def containment(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """Estimated share of the shingles of a that b holds."""
    return _compared(a, b, fraction, least, lambda n, x, y: F.coalesce(F.try_divide(n, x), F.lit(0.0)))


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def with_sketch(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sketch", sketch(F.col("text")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(key_of(id_col).alias("key"), text_of(text_col).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, sketch) of every row."""
    return with_sketch(keyed(docs, id_col, text_col))


def _ranges(rows: DataFrame, per_range: int = PER_RANGE) -> tuple[Column, Column]:
    """A row's place among those of one key, and the number of its range, ascending with key and place.

    Ranges follow the ids there are: up to `SPLITTERS` quantiles of them, found by a sketch, and between two of these
    ranges of equal width, so that far or crowded ids leave no range with more than its share. The place is the hash of the
    text where ids are missing, of which the last 64 ranges are, and 0 elsewhere: texts are read for it only then."""
    own = F.when(F.col("key") != NO_ID, F.col("key"))
    ends = rows.agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count(own).alias("n"), F.count(F.lit(1)).alias("all")).first()
    splitters = [0]
    if ends.n:
        parts = min(SPLITTERS, max(1, ends.n // per_range))
        told = rows.agg(F.percentile_approx(own, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first().q if parts > 1 else []
        splitters = sorted({ends.low, *told})
    each = min(MOST_RANGES // len(splitters), max(1, (ends.n or 0) // per_range // len(splitters) + 1))
    stops = [*splitters[1:], (ends.high or 0) + 1]
    widths = [min(1 << 62, max(1, -(-(b - a) // each))) for a, b in zip(splitters, stops, strict=True)]
    # Whole widths from 0 to each splitter, towards 0: what is subtracted never leaves the numbers of a range.
    bases = [-(-a // w) if a < 0 else a // w for a, w in zip(splitters, widths, strict=True)]
    longs = lambda x: F.lit(x).cast("array<long>")
    # The last splitter up to the key, by halving.
    steps = F.lit([1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(longs(splitters), low + step) <= F.col("key"), low + step).otherwise(low))
    within = lambda i: F.call_function("div", F.col("key"), F.get(longs(widths), i)) - F.get(longs(bases), i)
    known = F.get(F.transform(F.array(at), lambda i: i.cast("long") * each + F.greatest(F.lit(0).cast("long"), F.least(F.lit(each - 1).cast("long"), within(i)))), F.lit(0))
    if ends.n == ends.all:
        return F.lit(0).cast("long"), known
    missing = F.col("key") == NO_ID
    place = F.when(missing, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    # Signed numbers in order, from 0 to 63.
    sixth = F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(1 << 63))), 58)
    return place, F.when(missing, F.lit(len(splitters) * each).cast("long") + sixth).otherwise(known)


def _heads(rows: DataFrame) -> DataFrame:
    """(first, before): the smallest key and place of every range and the range before it, cyclically."""
    heads = rows.groupBy("range").agg(F.min(F.struct("key", "place")).alias("first"))
    order = Window.orderBy("range")
    return heads.select("first", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("before"))


def with_next(rows: DataFrame, columns: list[str], extend: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """extend(rows) for rows (key, text), with next_<column> of the next row in order; after the last that of
    the first. The few rows that are needed twice are found before they are extended."""
    place, of = _ranges(rows)
    dealt = rows.withColumn("place", place).withColumn("range", of)
    # Written first: its size is known then, and texts are not shuffled to find a few of them.
    heads = written(_heads(dealt.select("key", "place", "range")), "heads").select(F.col("first.key").alias("key"), F.col("first.place").alias("place"), "before")
    own = extend(dealt).withColumn("guest", F.lit(0))
    guests = extend(dealt.drop("range").join(heads, ["key", "place"]).withColumnRenamed("before", "range")).withColumn("guest", F.lit(1))
    order = Window.partitionBy("range").orderBy("guest", "key", F.xxhash64("text"), "text")
    both = own.unionByName(guests)
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("guest = 0").drop("guest", "range", "place")


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text, sketch, next_sketch, edited (the second half replaced by the next text's start), edited_sketch."""
    paired = with_next(keyed(docs, id_col, text_col), ["text", "sketch"], with_sketch)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return paired.select(id_of("key").alias("doc_id"), n.cast("long").alias("n_chars"), "text", "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
