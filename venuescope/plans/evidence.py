"""Queries over labelled evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as op
from ..operators import images, recommend
from ..sources import bindings as b
from .common import r6, s6

WANTED = ["click", "purchase", "view"]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return op.scored(b.events(spark, d), b.dimension(spark))


def _factors(spark: SparkSession, d: str) -> DataFrame:
    return op.factor_scores(_scored(spark, d))


def evidence_scored(spark, d):
    return _scored(spark, d).select("ordinal", "place", "factor", "category", "sentiment", "sentiment_value", r6("confidence"))


FACTOR_COLUMNS = ("place", "factor", "category", "mention_count", "total_mentions", "positive_count", "neutral_count", "mixed_count", "negative_count")
FACTOR_ROUNDED = ("factor_score", "avg_confidence", "mention_share", "weighted_score")
PLACE_COLUMNS = ("place", "evidence_count", "factor_count", "positive_count", "neutral_count", "mixed_count", "negative_count", "most_mentioned")
PLACE_ROUNDED = ("placeness_score", "mean_factor_score", "avg_confidence", "positive_ratio", "negative_ratio")


def factor_scores(spark, d):
    return _factors(spark, d).select(*FACTOR_COLUMNS, *map(r6, FACTOR_ROUNDED))


def place_scores(spark, d):
    return op.place_scores(_factors(spark, d)).select(*PLACE_COLUMNS, *map(r6, PLACE_ROUNDED))


def factor_table_completed(spark, d):
    few = _factors(spark, d).where("mention_count >= 13")
    done = op.completed(few, b.dimension(spark))
    return done.select("place", "factor", "factor_order", "category", "mention_count", "positive_count", "total_mentions", r6("factor_score"), r6("weighted_score"))


def evidence_examples(spark, d):
    return op.examples(_scored(spark, d), ["place", "factor"])


def evidence_all_texts(spark, d):
    return op.examples(_scored(spark, d), ["place"], None)


def review_mapping_counts(spark, d):
    return op.mapping_counts(_scored(spark, d))


def place_leaderboard(spark, d):
    return op.leaderboard(op.place_scores(_factors(spark, d)), 5, 200).select("place", "evidence_count", r6("placeness_score"))


def recommend_preset(spark, d):
    by_factor = _factors(spark, d)
    found = recommend.by_preference(by_factor, op.place_scores(by_factor), WANTED, 5, 20)
    return found.select("place", "matched", "factors", "top_factor", "rank", "evidence_count", r6("score"), r6("placeness_score"))


def recommend_evidence(spark, d):
    return recommend.evidence_for(_scored(spark, d), _factors(spark, d)).select("place", "factor", "ordinal", "rank", "sentiment_value")


def label_distribution(spark, d):
    rows = _scored(spark, d)
    total = rows.count()
    return rows.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", r6(F.col("n") * 100.0 / total, "percent"))


def summary_counts(spark, d):
    return _scored(spark, d).agg(F.countDistinct("review").alias("reviews"), F.countDistinct("place").alias("places"), F.count(F.lit(1)).alias("evidence"))


def value_counts(spark, d):
    return _scored(spark, d).groupBy("factor").agg(F.count(F.lit(1)).alias("n")).orderBy("n")


def category_means(spark, d):
    return op.by_category(_factors(spark, d)).select("place", "category", "factors", r6("category_score"))


def factor_scores_large(spark, d):
    rows = op.scored(b.large_evidence(spark, d), b.dimension(spark, b.PART_FACTORS))
    return op.factor_scores(rows).select(*FACTOR_COLUMNS, *map(r6, FACTOR_ROUNDED))


def place_scores_large(spark, d):
    rows = op.scored(b.large_evidence(spark, d), b.dimension(spark, b.PART_FACTORS))
    return op.place_scores(op.factor_scores(rows)).select(*PLACE_COLUMNS, *map(r6, PLACE_ROUNDED))


def readiness_score(spark, d):
    shots = b.events(spark, d).select("place", F.col("factor").alias("shot_type"), (F.col("confidence") * 2).alias("megapixels"), (F.col("place") % 2 == 0).alias("in_sequence"))
    done = images.readiness(shots, ["click", "view"], "error")
    full = images.holds_all(F.col("kinds"), ["click", "signup"])
    return done.select("place", "score", "label", "images", "shot_types", r6("megapixels"), full.alias("has_layout"))


def evidence_filters(spark, d):
    rows = _scored(spark, d).where(F.col("sentiment").rlike("positive|mixed") & F.col("evidence").startswith("p") & F.col("evidence").contains("-") & (F.col("factor") == "purchase"))
    return rows.orderBy(F.col("confidence").desc_nulls_last(), F.col("place").asc_nulls_last(), "ordinal").limit(3).select("place", "ordinal", "evidence")


def evidence_by_length(spark, d):
    own = _scored(spark, d).select("place", "evidence").distinct()
    return own.withColumn("length", F.length("evidence")).orderBy(F.desc("length"), "evidence", "place")


QUERIES = {
    f.__name__: f
    for f in (evidence_scored, factor_scores, place_scores, factor_table_completed, evidence_examples, evidence_all_texts, review_mapping_counts, place_leaderboard, recommend_preset, recommend_evidence, label_distribution, summary_counts, value_counts, category_means, factor_scores_large, place_scores_large, readiness_score, evidence_filters, evidence_by_length)
}

W = f"WITH {b.EVENTS_SQL}"
FACTOR_SQL = ", ".join([*FACTOR_COLUMNS, *map(s6, FACTOR_ROUNDED)])
PLACE_SQL = ", ".join([*PLACE_COLUMNS, *map(s6, PLACE_ROUNDED)])
LARGE = (
    W.replace("('click', 0, 'physical'), ('error', 1, 'physical'), ('purchase', 2, 'activity'), ('signup', 3, 'activity'), ('view', 4, 'meaning')", "('ECONOMY', 0, 'physical'), ('LARGE', 1, 'physical'), ('MEDIUM', 2, 'activity'), ('PROMO', 3, 'activity'), ('SMALL', 4, 'meaning'), ('STANDARD', 5, 'meaning')")
    .replace("SELECT user_id AS place, event_type AS factor,", "SELECT l_suppkey AS place, p_type AS factor,")
    .replace("CASE WHEN value >= 60 THEN 'positive' WHEN value >= 30 THEN 'mixed' WHEN value >= 15 THEN 'neutral' ELSE 'negative' END", "CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END")
    .replace("CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, event_id // 4 AS review,", "l_discount AS confidence,")
    .replace("event_type || '-' || CAST(event_id % 7 AS VARCHAR) AS evidence, event_id AS ordinal FROM events", "'' AS evidence, l_orderkey AS ordinal FROM lineitem JOIN part ON l_partkey = p_partkey")
)
EXAMPLES_SQL = W + """, t AS (SELECT place{0}, evidence AS text, min(ordinal) AS ordinal FROM scored GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY place{0} ORDER BY ordinal) AS n FROM t)
SELECT place{0}, string_agg(text, ' | ' ORDER BY ordinal) AS examples FROM n {1} GROUP BY ALL"""
ORACLE_SQL = {
    "evidence_scored": f"{W} SELECT ordinal, place, factor, category, sentiment, sentiment_value, {s6('confidence')} FROM scored",
    "factor_scores": f"{W} SELECT {FACTOR_SQL} FROM fsw",
    "place_scores": f"{W} SELECT {PLACE_SQL} FROM ps JOIN best USING (place)",
    "factor_table_completed": f"""{W}, few AS (SELECT * FROM fsw WHERE mention_count >= 13)
        SELECT p.place, d.factor, d.factor_order, d.category, coalesce(mention_count, 0) AS mention_count, coalesce(positive_count, 0) AS positive_count,
        coalesce(total_mentions, 0) AS total_mentions, {s6("factor_score")}, {s6("weighted_score")}
        FROM (SELECT DISTINCT place FROM few) p CROSS JOIN dim d LEFT JOIN few f ON f.place = p.place AND f.factor = d.factor""",
    "evidence_examples": EXAMPLES_SQL.format(", factor", "WHERE n <= 4"),
    "evidence_all_texts": EXAMPLES_SQL.format("", ""),
    "review_mapping_counts": f"""{W} SELECT review, count(*) AS mappings, arg_min(evidence, ordinal) AS first_text,
        CAST(review AS VARCHAR) || ' · ' || substr(arg_min(evidence, ordinal), 1, 54) AS label FROM scored GROUP BY review""",
    "place_leaderboard": f"{W} SELECT place, evidence_count, {s6('placeness_score')} FROM (SELECT * FROM ps WHERE evidence_count >= 5 ORDER BY evidence_count DESC, round(placeness_score, 9) DESC, place LIMIT 200)",
    "recommend_preset": f"""{W}, own AS (SELECT * FROM fsw WHERE factor IN ('click', 'purchase', 'view')),
        top AS (SELECT place, factor AS top_factor FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(factor_score, 9) DESC, mention_count DESC, factor_order) AS n FROM own) WHERE n = 1),
        s AS (SELECT place, avg(factor_score) AS score, count(*) AS matched, string_agg(factor, ', ' ORDER BY factor_order) AS factors FROM own GROUP BY place),
        r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, matched DESC, round(placeness_score, 9) DESC, place) AS rank
              FROM s JOIN top USING (place) JOIN ps USING (place) WHERE evidence_count >= 5)
        SELECT place, matched, factors, top_factor, CAST(rank AS INT) AS rank, evidence_count, {s6("score")}, {s6("placeness_score")} FROM r WHERE rank <= 20""",
    "recommend_evidence": f"""{W}, t AS (SELECT place, factor FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(factor_score, 9) DESC, mention_count DESC, factor_order) AS n FROM fsw) WHERE n <= 3),
        r AS (SELECT s.*, row_number() OVER (PARTITION BY place ORDER BY sentiment_value DESC, factor, ordinal) AS rank FROM scored s SEMI JOIN t USING (place, factor))
        SELECT place, factor, ordinal, CAST(rank AS INT) AS rank, sentiment_value FROM r WHERE rank <= 8""",
    "label_distribution": f"{W} SELECT sentiment, count(*) AS n, round((count(*) * 100.0::DOUBLE / (SELECT count(*) FROM scored)) + 1e-10::DOUBLE, 6) + 0.0 AS percent FROM scored GROUP BY sentiment",
    "summary_counts": f"{W} SELECT count(DISTINCT review) AS reviews, count(DISTINCT place) AS places, count(*) AS evidence FROM scored",
    "value_counts": f"{W} SELECT factor, count(*) AS n FROM scored GROUP BY factor",
    "category_means": f"{W} SELECT place, category, count(*) AS factors, round((avg(factor_score)) + 1e-10::DOUBLE, 6) + 0.0 AS category_score FROM fsw GROUP BY place, category",
    "factor_scores_large": f"{LARGE} SELECT {FACTOR_SQL} FROM fsw",
    "place_scores_large": f"{LARGE} SELECT {PLACE_SQL} FROM ps JOIN best USING (place)",
    "readiness_score": f"""{W}, shots AS (SELECT place, factor AS shot, confidence * 2 AS mp FROM evidence),
        s AS (SELECT place, count(*) AS images, count(DISTINCT shot) FILTER (shot <> 'error') AS shot_types, avg(mp) AS megapixels,
              bool_or(shot IN ('click', 'view')) AS k, bool_or(shot = 'click') AND bool_or(shot = 'signup') AS has_layout FROM shots GROUP BY place),
        r AS (SELECT *, CAST(least(100, least(40, images * 4) + least(25, shot_types * 6) + CASE WHEN place % 2 = 0 THEN 20 ELSE 0 END
              + CASE WHEN megapixels >= 1.2 THEN 10 WHEN megapixels >= 0.6 THEN 5 ELSE 0 END + CASE WHEN k THEN 5 ELSE 0 END) AS INT) AS score FROM s)
        SELECT place, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS label, images, CAST(shot_types AS INT) AS shot_types, {s6("megapixels")}, has_layout FROM r""",
    "evidence_filters": f"""{W} SELECT place, ordinal, evidence FROM scored WHERE sentiment IN ('positive', 'mixed')
        AND starts_with(evidence, 'p') AND contains(evidence, '-') AND factor = 'purchase' ORDER BY confidence DESC NULLS LAST, place NULLS LAST, ordinal LIMIT 3""",
    "evidence_by_length": f"{W} SELECT DISTINCT place, evidence, CAST(length(evidence) AS INT) AS length FROM scored",
}
