"""Evidence scoring: labelled evidence rows to factor scores to place scores.

Evidence has place, factor, hint, confidence, evidence and an ordinal that gives its order.
`factors` is the dimension: factor, factor_order, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import EXAMPLES, FACTOR_CATEGORIES, FACTOR_ENGLISH, FACTOR_ORDER
from ..functions.sentiment import hint_key, hint_value
from ..functions.text import strip

#: Factors that are inlined into plans, at most.
MOST_FACTORS = 1000
REQUIRED = ("place", "factor", "hint", "confidence", "evidence", "ordinal")


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def dimension_rows(factors: DataFrame) -> list:
    """The rows (factor, factor_order, category) of the dimension, whose size is checked before it is inlined."""
    rows = factors.select("factor", "factor_order", "category").limit(MOST_FACTORS + 1).collect()
    if len(rows) > MOST_FACTORS:
        raise ValueError(f"more than {MOST_FACTORS} factors are no dimension")
    return rows


def factor_dimension(spark: SparkSession) -> DataFrame:
    """The ten factors: factor, factor_order, category, english."""
    category = {f: c for c, own in FACTOR_CATEGORIES.items() for f in own}
    rows = [(f, i, category[f], FACTOR_ENGLISH[i]) for i, f in enumerate(FACTOR_ORDER)]
    return spark.createDataFrame(rows, "factor string, factor_order int, category string, english string")


def scored(evidence: DataFrame, factors: DataFrame) -> DataFrame:
    """Evidence of known factors with sentiment (key and value), confidence as a number, and category.

    The dimension has a row per factor, tens at most; see `dimension_rows`."""
    require(evidence, REQUIRED)
    own = evidence.withColumn("factor", strip(F.col("factor")))
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("name", "factor_order", "category"), r, strict=True))) for r in dimension_rows(factors)))
    # Inlined: a lookup among tens of factors takes no join.
    known = own.withColumn("__f", F.try_element_at(F.filter(listed, lambda f: f["name"] == F.col("factor")), F.lit(1))).where("__f is not null")
    known = known.select("*", "__f.factor_order", "__f.category").drop("__f")
    sentiment = hint_key(F.col("hint"))
    return known.withColumn("confidence", F.nanvl(F.col("confidence").try_cast("double"), F.lit(None).cast("double"))).withColumn("sentiment", sentiment).withColumn("sentiment_value", hint_value(sentiment))


def _count(key: str) -> Column:
    return F.count_if(F.col("sentiment") == key).alias(f"{key}_count")


def factor_scores(rows: DataFrame) -> DataFrame:
    """Per place and factor: mentions, mean sentiment, mean confidence, counts, share and weighted score."""
    sums = rows.groupBy("place", "factor").agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.avg("sentiment_value").alias("factor_score"),
        F.avg("confidence").alias("avg_confidence"),
        *map(_count, ("positive", "neutral", "mixed", "negative")),
        F.min("category").alias("category"),
        F.min("factor_order").alias("factor_order"),
    )
    own = Window.partitionBy("place")
    total = F.sum("mention_count").over(own)
    return sums.withColumn("total_mentions", total).withColumn("mention_share", F.col("mention_count") / total).withColumn("weighted_score", F.col("factor_score") * F.col("mention_count") / total)


def place_scores(by_factor: DataFrame) -> DataFrame:
    """Per place: the weighted score, counts, ratios and the factor mentioned most.

    Ties go to the better score, then to the factor that comes first. One shuffle: the factor rows are
    already dealt by place."""
    best = F.struct(F.col("mention_count"), F.col("factor_score"), (-F.col("factor_order")).alias("o"))
    sums = by_factor.groupBy("place").agg(
        F.sum("weighted_score").alias("placeness_score"),
        F.sum("mention_count").alias("evidence_count"),
        F.count(F.lit(1)).alias("factor_count"),
        F.avg("factor_score").alias("mean_factor_score"),
        *(F.sum(f"{k}_count").alias(f"{k}_count") for k in ("positive", "neutral", "mixed", "negative")),
        F.avg("avg_confidence").alias("avg_confidence"),
        F.max_by("factor", best).alias("most_mentioned"),
    )
    ratio = lambda k: F.coalesce(F.try_divide(F.col(f"{k}_count"), F.col("evidence_count")), F.lit(0.0)).alias(f"{k}_ratio")
    return sums.select("*", ratio("positive"), ratio("negative"))


def completed(by_factor: DataFrame, factors: DataFrame) -> DataFrame:
    """A row for every place and factor; counts are 0 and scores null where a factor is not mentioned."""
    places = by_factor.select("place").distinct()
    # The dimension has a row per factor: every place gets that many rows.
    grid = places.withColumn("f", F.explode(F.array(*(F.struct(F.lit(r.factor).alias("factor"), F.lit(r.factor_order).alias("factor_order"), F.lit(r.category).alias("category")) for r in dimension_rows(factors))))).select("place", "f.*")
    counts = ("mention_count", "positive_count", "neutral_count", "mixed_count", "negative_count", "total_mentions")
    joined = grid.join(by_factor.drop("factor_order", "category"), ["place", "factor"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def examples(rows: DataFrame, keys: list[str], most: int | None = EXAMPLES) -> DataFrame:
    """The first different evidence texts of each key in order, joined; blank ones and "nan" are left out."""
    text = strip(F.coalesce("evidence", F.lit("")))
    own = rows.withColumn("text", text).where((F.col("text") != "") & (F.lower("text") != "nan"))
    first = own.groupBy(*keys, "text").agg(F.min("ordinal").alias("ordinal"))
    if most:
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "text"))).where(F.col("n") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return first.groupBy(*keys).agg(F.array_join(listed, " | ").alias("examples"))


def mapping_counts(rows: DataFrame) -> DataFrame:
    """Per review: evidence rows and the first text, with a short label."""
    sums = rows.groupBy("review").agg(F.count(F.lit(1)).alias("mappings"), F.min_by("evidence", "ordinal").alias("first_text"))
    return sums.withColumn("label", F.concat(F.col("review").cast("string"), F.lit(" · "), F.substring("first_text", 1, 54)))


def by_category(by_factor: DataFrame) -> DataFrame:
    return by_factor.groupBy("place", "category").agg(F.avg("factor_score").alias("category_score"), F.count(F.lit(1)).alias("factors"))


def leaderboard(places: DataFrame, least: int, most: int) -> DataFrame:
    """Places with enough evidence, the most evidence first, then the best score, then the place."""
    order = [F.desc("evidence_count"), F.desc(F.round("placeness_score", 9)), F.asc("place")]
    return places.where(F.col("evidence_count") >= least).orderBy(*order).limit(most)
