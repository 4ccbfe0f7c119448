"""Collecting and matching places: slices, samples, resuming, duplicates, fuzzy matches, nearest stations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EARTH_M
from ..functions.geo import haversine, walking_minutes
from ..sources.kept import written


def known_reviews(rows: DataFrame, place: str = "place", text: str = "review_text") -> DataFrame:
    """Rows with a place and a review that is not blank."""
    return rows.dropna(subset=[place, text]).where(F.regexp_replace(text, r"^\s+|\s+$", "") != "")


def with_defaults(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their new names, where no column has that name yet."""
    return rows.withColumns({new: F.col(old) for old, new in names.items() if old in rows.columns and new not in rows.columns})


def numbered(rows: DataFrame, ordinal: str, name: str = "review_index", ranges: int | None = None) -> DataFrame:
    """Positions from 0 by an ordinal, rows without one last, and no task that holds more than its share of them.

    Rows are dealt to ranges by splitters that Spark samples, so any ordinals, dense, hashed or with outliers, make
    ranges of about one size; rows of one ordinal, or of none, are dealt on by a hash of all they hold, rows alike by
    where they were read. Each range is sorted and written as a file of its own, so a row's position is the number
    of rows in the files before it and its place in its file; both are read with the rows."""
    spark, names = rows.sparkSession, rows.columns
    own = rows.toDF(*(f"c{i}" for i in range(len(names))))
    by = F.col(own.columns[names.index(ordinal)])
    told = F.xxhash64(*(c for c, t in own.dtypes if not t.startswith("map")))
    keys = [by.asc_nulls_last(), told.asc(), F.monotonically_increasing_id().asc()]
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.rdd.getNumPartitions())
    table = written(own.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys[:2]), "numbered")
    file, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    read = table.select("*", file.alias("file"), place.alias("place"))
    # One row a file; names of files ascend with the ranges.
    sizes = read.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))
    at = (F.col("start") + F.col("place")).cast("long")
    return read.join(F.broadcast(starts), "file").select(*(F.col(c).alias(n) for c, n in zip(own.columns, names, strict=True)), at.alias(name))


def place_slice(rows: DataFrame, start: int, stop: int, place: str = "place", ordinal: str = "ordinal") -> DataFrame:
    """Rows of the places from `start` to before `stop` in order of first appearance."""
    first = rows.groupBy(place).agg(F.min(ordinal).alias("first"))
    wanted = first.orderBy("first").limit(stop)
    kept = wanted.withColumn("__n", F.row_number().over(Window.orderBy("first"))).where(F.col("__n") > start)
    return rows.join(kept.select(place), place, "left_semi")


def in_order(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct keys with the ordinal of their first appearance."""
    return rows.groupBy(key).agg(F.min(ordinal).alias("first"))


def left_to_do(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def after_last(todo: DataFrame, done: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows after the last one whose key is among the done ones; all rows if none is."""
    last = todo.join(done.select(key).distinct(), key, "left_semi").agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("__last"))
    return todo.join(F.broadcast(last)).where(F.col(ordinal) > F.col("__last")).drop("__last")


def first_of_copies(rows: DataFrame, keys: list[Column], ordinal: str, most: int | None = None, within: str | None = None) -> DataFrame:
    """The first row of every key; then at most `most` of each group."""
    names = [f"__k{i}" for i in range(len(keys))]
    dealt = rows.withColumns(dict(zip(names, keys, strict=True)))
    kept = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(ordinal))).where("__n = 1").drop("__n", *names)
    if most:
        kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(within).orderBy(ordinal))).where(F.col("__n") <= most).drop("__n")
    return kept


def stratified(rows: DataFrame, stratum: str, key: str, most: int = 100, seed: int = 42) -> DataFrame:
    """At most `most` rows of every stratum by a seeded hash; short strata stay whole."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(place, key))).where(F.col("__n") <= most).drop("__n")


def joined_md5(rows: DataFrame, group: list[str], text: str, ordinal: str, name: str = "texts") -> DataFrame:
    """(group, name): the MD5 of each group's texts in order, joined by line ends; groups without a text have no row.

    Such a sum takes its bytes in order, so a group is one task's work; but no task gathers it: the sorted rows, which
    spill to disk, are read a batch at a time, and only the sum's state is kept."""
    own = rows.where(F.col(text).isNotNull()).select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), F.col(ordinal).alias("o"), F.col(text).cast("binary").alias("t"))
    keys = [f"g{i}" for i in range(len(group))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        done: list = []
        for b in batches:
            types = [f.type for f in b.schema][:-1]
            for *key, text in zip(*(c.to_pylist() for c in b.columns[:-1]), b.column(len(keys)), strict=True):
                if own is None or key != last:
                    if own is not None:
                        done.append((*last, own.hexdigest()))
                    last, own = key, hashlib.md5(usedforsecurity=False)
                else:
                    own.update(b"\n")
                own.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*types, pa.string()], strict=True)], [*keys, "md5"])
                done = []
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*last, own.hexdigest()), [*types, pa.string()], strict=True)], [*keys, "md5"])

    dealt = own.repartition(*keys).sortWithinPartitions(*keys, "o", "t").select(*keys, "t")
    schema = ", ".join([*(f"{k} {t}" for k, t in dealt.dtypes[:-1]), "md5 string"])
    return dealt.mapInArrow(run, schema).toDF(*group, name)


def only_blank(rows: DataFrame, place: str, text: str) -> DataFrame:
    """Places that have rows but no review that is not blank."""
    told = F.max((F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "") != "").cast("int"))
    return rows.groupBy(place).agg(told.alias("__told")).where("__told = 0").select(place)


def matched(places: DataFrame, known: DataFrame) -> DataFrame:
    """The first known point of every place: same name before names that start with it; within the same
    district, and the same neighbourhood where the place has one.

    places: place, name, district, neighborhood; known: k_name, k_district, k_neighborhood, ordinal, lat, lng.
    Known names are indexed by those of their prefixes that are asked for in their district: prefixes of the lengths
    that names asked for there have, then the names themselves. Of each the best point is kept before any join, so a
    name meets one row, however many start with it, and all joins are by whole names."""
    asked = places.select("name", "district", "neighborhood").where("name is not null and district is not null")
    lengths = asked.groupBy("district").agg(F.collect_set(F.length("name")).alias("lengths"))
    begun = known.join(lengths, F.col("k_district") == F.col("district")).drop("district")
    size = F.length("k_name")
    # The empty name is a prefix of no other one.
    own = F.filter("lengths", lambda n: (n <= size) & ((n > 0) | (size == 0)))
    begun = begun.withColumn("n", F.explode(own)).withColumn("prefix", F.expr("left(k_name, n)"))
    begun = begun.join(asked.select(F.col("district").alias("k_district"), F.col("name").alias("prefix")).distinct(), ["k_district", "prefix"], "left_semi")
    best = F.min(F.struct(F.when(F.col("n") == size, 1).otherwise(2).alias("tier"), "ordinal", "lat", "lng")).alias("m")
    anywhere = begun.groupBy(F.col("k_district").alias("district"), F.col("prefix").alias("name")).agg(best)
    nearby = begun.where("k_neighborhood is not null").groupBy(F.col("k_district").alias("district"), F.col("k_neighborhood").alias("neighborhood"), F.col("prefix").alias("name")).agg(best)
    told = asked.distinct()
    found = told.where("neighborhood is null").join(anywhere, ["district", "name"]).unionByName(told.where("neighborhood is not null").join(nearby, ["district", "neighborhood", "name"]))
    found = found.select(F.col("name").alias("own_name"), F.col("district").alias("own_district"), F.col("neighborhood").alias("own_hood"), "m")
    same = (F.col("name") == F.col("own_name")) & (F.col("district") == F.col("own_district")) & F.col("neighborhood").eqNullSafe(F.col("own_hood"))
    # Of rows of one place the best point counts.
    one = places.join(found, same).groupBy("place").agg(F.min("m").alias("m"))
    return places.select("place").join(one, "place", "left").select("place", F.col("m.tier").alias("tier"), F.col("m.ordinal").alias("match"), F.col("m.lat").alias("lat"), F.col("m.lng").alias("lng"))


#: The smallest ring, and meetings of points and stations in a ring that a point may have on average.
FINEST_M, MEETINGS = 10.0, 64


def _row(lat: Column, level: int) -> Column:
    """The row of cells of a latitude: rows are 180 / 2^level degrees high."""
    return F.greatest(F.lit(0), F.least(F.floor((lat + 90.0) / (180.0 / (1 << level))), F.lit((1 << level) - 1))).cast("long")


def _cells_of(row: Column, level: int) -> Column:
    """The cells of a row, about as wide as high: fewer towards the poles."""
    side = 180.0 / (1 << level)
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians((row + 0.5) * side - 90.0)) * (2 << level))).cast("long")


def _cell(lat: Column, lng: Column, level: int) -> Column:
    row = _row(lat, level)
    return F.struct(row.alias("y"), F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * _cells_of(row, level)).cast("long").alias("x"))


def _around(lat: Column, lng: Column, metres: float, level: int) -> Column:
    """All cells that hold a place within so many metres of a point: round the globe, and the whole row about a pole."""
    angle = min(metres / EARTH_M, math.pi) * (1 + 1e-9) + 1e-9
    degrees = math.degrees(angle)
    # How far east and west the circle reaches; all round, once it holds a pole.
    reach = F.try_divide(F.lit(math.sin(min(angle, math.pi / 2))), F.cos(F.radians(lat)))
    polar = (lat + degrees >= 90.0) | (lat - degrees <= -90.0) | reach.isNull() | (reach >= 1.0)
    wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))))
    rows = F.sequence(_row(lat - degrees, level), _row(lat + degrees, level))

    def cells(y: Column) -> Column:
        n = _cells_of(y, level)
        first = F.floor((lng + 180.0 - wide) / 360.0 * n).cast("long")
        last = F.least(F.floor((lng + 180.0 + wide) / 360.0 * n).cast("long"), first + n - 1)
        return F.transform(F.sequence(first, last), lambda x: F.struct(y.alias("y"), F.pmod(x, n).alias("x")))

    return F.flatten(F.transform(rows, cells))


def _level(metres: float) -> int:
    """The level whose rows are about as high as so many metres, so that a circle meets a few cells."""
    return max(0, min(24, math.floor(math.log2(math.pi * EARTH_M / max(metres, FINEST_M)))))


def _on_globe(lat: Column, lng: Column) -> tuple[Column, Column]:
    """The same place with a latitude of -90 to 90: one beyond a pole lies on the other side of the globe."""
    turned = F.pmod(lat + 90.0, F.lit(360.0))
    inside = lat.between(-90.0, 90.0)
    own = F.when(inside, lat).when(turned <= 180.0, turned - 90.0).otherwise(270.0 - turned)
    return own, F.when(inside | (turned <= 180.0), lng).otherwise(lng + 180.0)


def _met(points: DataFrame, stations: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Points in every cell that a ring touches, stations in their own."""
    level = _level(metres)
    a = points.withColumns(dict(zip(("__lat", "__lng"), _on_globe(F.col("lat"), F.col("lng")), strict=True)))
    b = stations.withColumns(dict(zip(("__lat", "__lng"), _on_globe(F.col("s_lat"), F.col("s_lng")), strict=True)))
    a = a.withColumn("cell", F.explode(_around(F.col("__lat"), F.col("__lng"), metres, level)))
    return a.drop("__lat", "__lng"), b.withColumn("cell", _cell(F.col("__lat"), F.col("__lng"), level)).drop("__lat", "__lng")


def _first_ring(points: DataFrame, stations: DataFrame, limit: float) -> float:
    """The widest ring up to the limit in which a point meets a bounded number of stations on average: told by counts a cell."""
    n, ring = points.count(), limit
    while ring > FINEST_M:
        a, b = _met(points, stations, ring)
        counts = a.groupBy("cell").agg(F.count(F.lit(1)).alias("p")).join(b.groupBy("cell").agg(F.count(F.lit(1)).alias("s")), "cell")
        if (counts.agg(F.sum(F.col("p").cast("double") * F.col("s"))).first()[0] or 0) <= MEETINGS * n:
            break
        ring = max(FINEST_M, ring / 8)
    return ring


def nearest(points: DataFrame, stations: DataFrame, reach_m: float | None = 600.0) -> DataFrame:
    """The station with the shortest walk within reach (None: anywhere), ties by ordinal; null where none is.

    points: point, lat, lng; stations: station, kind, s_lat, s_lng, ordinal; what has no place is near nothing. Cells
    of the globe turn the search into equi-joins, ring by ring. The first ring is the widest in which a point meets few
    stations, told by counts of both in every cell, so a crowded city does not meet itself; each further ring is four
    times as wide, up to the reach, and only points that no smaller ring has settled go on. Cells follow the ring's
    radius and the latitude and go round the globe and over the poles, so all within the ring is met; latitudes beyond a
    pole, which the distance takes as they are, have the cell of the place that they stand for. A point is settled
    when its best walk is shorter than the walk to the ring's edge: no farther station can tie with it."""
    limit = math.pi * EARTH_M if reach_m is None else min(float(reach_m), math.pi * EARTH_M)
    known = stations.where("s_lat is not null and s_lng is not null")
    left, done = points.select("point", "lat", "lng").where("lat is not null and lng is not null"), []
    ring = _first_ring(left, known, limit)
    while True:
        a, b = _met(left, known, ring)
        found = a.join(b, "cell").withColumn("metres", haversine(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))).where(F.col("metres") <= ring)
        best = found.withColumn("minutes", walking_minutes(F.col("metres"))).groupBy("point").agg(F.min(F.struct("minutes", "ordinal", "station", "kind", "metres")).alias("b"))
        if ring >= limit:
            done.append(best)
            break
        settled = written(best.where(F.col("b.minutes") < walking_minutes(F.lit(ring))), "nearest")
        done.append(settled)
        left = written(left.join(settled.select("point"), "point", "left_anti"), "unsettled")
        if left.isEmpty():
            break
        ring = min(ring * 4, limit)
    best = reduce(DataFrame.unionByName, done)
    return points.join(best, "point", "left").select("point", F.col("b.station").alias("station"), F.col("b.kind").alias("kind"), F.col("b.minutes").alias("minutes"), F.col("b.metres").alias("metres"))


def row_slice(rows: DataFrame, start: int, stop: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows from position `start` to before `stop` by an ordinal."""
    return numbered(rows, ordinal, "__at").where((F.col("__at") >= start) & (F.col("__at") < stop)).drop("__at")


#: Letters of a gram of the index of names.
GRAM = 3


def _grams(text: str) -> Column:
    """The distinct grams of a text, and its shorter pieces, which words shorter than a gram are looked up by."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(spots, lambda i: F.array(*(F.substring(F.col(text), i, F.lit(n)) for n in range(1, GRAM + 1))))))


def districts_of(names: DataFrame, known: DataFrame) -> DataFrame:
    """The district of every name (place): of the same place, else of the place that is its first word, else
    of the first known place that starts with or holds that word; a blank name has none.

    known: k_place, district, ordinal. All steps are equi-joins. For words that the first two leave over, the known
    places are indexed by the grams of three letters that these words have. A gram's count and its first place are summed
    before any join: a word of up to three letters is a gram, and has its answer there; a longer one meets the
    places of its rarest gram only, so a gram that half of all places hold is met by words that have no rarer one."""
    word = F.element_at(F.split("place", " "), 1)
    firsts = known.where("district is not null").groupBy("k_place").agg(F.min(F.struct("ordinal", "district")).alias("d"))
    firsts = firsts.select("k_place", F.col("d.ordinal").alias("ordinal"), F.col("d.district").alias("district"))
    exact = firsts.select(F.col("k_place").alias("place"), F.col("district").alias("d1"))
    begun = firsts.select(F.col("k_place").alias("word"), F.col("district").alias("d2"))
    told = names.select("place").distinct().withColumn("word", word).join(exact, "place", "left").join(begun, "word", "left")
    rest = written(told.where("d1 is null and d2 is null and word <> ''").select("word").distinct(), "words")
    short, long = rest.where(F.length("word") <= GRAM), rest.where(F.length("word") > GRAM)
    spots = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    asked = long.select("word", F.explode(F.array_distinct(F.transform(spots, lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))).alias("gram"))
    wanted = asked.select("gram").unionByName(short.select(F.col("word").alias("gram"))).distinct()
    held = written(firsts.select("k_place", "ordinal", "district", F.explode(_grams("k_place")).alias("gram")).join(wanted, "gram", "left_semi"), "grams")
    counts = written(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "district")).alias("d")), "gram-counts")
    answers = short.join(counts, short["word"] == counts["gram"]).select("word", "d")
    # A gram that no place holds counts 0: its words are in none.
    rarest = asked.join(counts, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select("word", F.col("r.gram").alias("gram"))
    longer = rarest.join(held, "gram").where(F.col("k_place").contains(F.col("word"))).groupBy("word").agg(F.min(F.struct("ordinal", "district")).alias("d"))
    out = told.join(answers.unionByName(longer), "word", "left")
    tier = F.when(F.col("d1").isNotNull(), 1).when(F.col("d2").isNotNull(), 2).when(F.col("d").isNotNull() & F.col("d1").isNull(), 3)
    return out.select("place", F.coalesce("d1", "d2", "d.district").alias("district"), tier.alias("tier"))
