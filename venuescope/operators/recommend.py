"""Recommendations from factor scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NEUTRAL, PRESETS


def by_preference(by_factor: DataFrame, places: DataFrame, wanted: list[str], least: int = 1, most: int = 20) -> DataFrame:
    """Places by the mean score of the wanted factors they mention: score, how many, their names, the best."""
    own = by_factor.where(F.col("factor").isin(wanted))
    best = F.struct(F.round("factor_score", 9).alias("s"), F.col("mention_count").alias("n"), (-F.col("factor_order")).alias("o"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("factor_order", "factor"))), lambda x: x["factor"])
    sums = own.groupBy("place").agg(F.avg("factor_score").alias("score"), F.count(F.lit(1)).alias("matched"), F.array_join(names, ", ").alias("factors"), F.max_by("factor", best).alias("top_factor"))
    told = sums.join(places.select("place", "placeness_score", "evidence_count"), "place").where(F.col("evidence_count") >= least)
    order = [F.desc(F.round("score", 9)), F.desc("matched"), F.desc(F.round("placeness_score", 9)), F.asc("place")]
    # The order is over at most `most` rows.
    first = told.orderBy(*order).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_preset(by_factor: DataFrame, places: DataFrame, preset: str, least: int = 1, most: int = 20) -> DataFrame:
    """`by_preference` for a preset's factors."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}; there are {', '.join(PRESETS)}")
    return by_preference(by_factor, places, PRESETS[preset], least, most)


def evidence_for(rows: DataFrame, by_factor: DataFrame, factors: int = 3, most: int = 8) -> DataFrame:
    """Per place, evidence of its best factors: the best sentiment first, then by factor and order."""
    best = Window.partitionBy("place").orderBy(F.desc(F.round("factor_score", 9)), F.desc("mention_count"), "factor_order")
    top = by_factor.withColumn("n", F.row_number().over(best)).where(F.col("n") <= factors).select("place", "factor")
    order = Window.partitionBy("place").orderBy(F.desc("sentiment_value"), "factor", "ordinal")
    return rows.join(top, ["place", "factor"], "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def by_mean(scores: DataFrame, wanted: list[str], calculated: str = "fsi", raw: str = "fsi_raw") -> DataFrame:
    """Mean over the wanted factors: the calculated score, else the raw one, else neutral."""
    own = scores.where(F.col("factor").isin(wanted))
    value = F.coalesce(F.col(calculated), F.col(raw), F.lit(NEUTRAL)) if raw in scores.columns else F.coalesce(F.col(calculated), F.lit(NEUTRAL))
    return own.groupBy("place").agg(F.avg(value).alias("score"))


def by_told_mean(scores: DataFrame, wanted: list[str], column: str = "fsi") -> DataFrame:
    """Mean over the wanted factors that differ from neutral; places without any are left out."""
    own = scores.where(F.col("factor").isin(wanted))
    told = own.groupBy("place").agg(F.coalesce(F.avg(F.nullif(F.col(column), F.lit(NEUTRAL))), F.lit(0.0)).alias("score"))
    return told.where("score > 0")
