"""Numbers as readers see them, and rows as charts want them. For the edge only: queries keep numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _or_dash(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), "-").otherwise(text)


def score(value: Column) -> Column:
    return _or_dash(value, F.format_string("%.3f", value.cast("double")))


def signed(value: Column) -> Column:
    """Three decimals with a sign; zero has none."""
    own = value.cast("double")
    return _or_dash(value, F.when(F.round(own, 3) == 0, "0.000").otherwise(F.format_string("%+.3f", own)))


def percent(value: Column, digits: int = 1) -> Column:
    return _or_dash(value, F.format_string(f"%.{digits}f%%", value.cast("double") * 100))


def count(value: Column, unit: str = "") -> Column:
    """Thousands parted by commas, with a unit."""
    return _or_dash(value, F.concat(F.format_number(value.cast("double"), 0), F.lit(unit)))


def radar(scores: DataFrame, value: str = "fsi", order: str = "factor_order") -> DataFrame:
    """Points of each place's polygon in order, the first again at the end."""
    own = scores.withColumn("point", F.row_number().over(Window.partitionBy("place").orderBy(order)))
    last = own.groupBy("place").agg(F.max("point").alias("n"))
    again = own.where("point = 1").join(last, "place").withColumn("point", (F.col("n") + 1).cast("int")).drop("n")
    return own.unionByName(again).select("place", "factor", "point", value)


def heat(points: DataFrame, value: str) -> DataFrame:
    """[lat, lng, value] of the points that have all three."""
    return points.dropna(subset=["lat", "lng", value]).select(F.array("lat", "lng", F.col(value).cast("double")).alias("row"))


def by_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Without the columns whose names end so."""
    return df.drop(*(c for c in df.columns if c.endswith(suffix)))


def by_prefix(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *(c for c in df.columns if c.startswith(prefix)))
