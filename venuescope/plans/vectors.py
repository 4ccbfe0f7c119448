"""Queries over vectors: similarity, factor scores, weights, deviants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import blended, boosted, keyword_boost
from ..operators import mapping, recommend
from ..operators import similarity as op
from ..sources import bindings as b
from .common import r6, s6

WANTED = ["f0", "f3", "f7"]


def _similar(spark, d):
    return op.similarities(b.sentences(spark, d), b.anchors(spark, d))


def _mentions(spark, d):
    return op.similarities(b.sentences(spark, d), b.anchors(spark, d), b.CUT)


def _reviews(spark, d):
    return op.review_scores(_mentions(spark, d))


def _weighted(spark, d):
    return op.weights(op.fsi(_reviews(spark, d), b.place_grid(spark, d)))


def similarity_long(spark, d):
    return _similar(spark, d).select("sentence", "factor", r6("similarity"))


def factor_mentions(spark, d):
    return _mentions(spark, d).select("place", "review", "sentence", "factor", r6("similarity"), r6("sentiment"))


def review_factor_scores(spark, d):
    return _reviews(spark, d).select("place", "review", "factor", "sentences", r6("review_score"), r6("similarity"))


def fsi(spark, d):
    return op.fsi(_reviews(spark, d), b.place_grid(spark, d)).select("place", "factor", "n", r6("fsi"))


def weights(spark, d):
    return _weighted(spark, d).select("place", "factor", r6("weight"))


def mu_sigma(spark, d):
    return op.mu_sigma(_weighted(spark, d)).select("place", r6("mu"), r6("sigma"))


def deviant_factors(spark, d):
    return op.deviants(_weighted(spark, d)).select("place", "strong", "weak", r6("mu"))


def place_metrics_wide(spark, d):
    names = [n for _, n in b.VECTOR_FACTORS]
    wide = op.wide(_weighted(spark, d), names)
    return wide.select("place", *(r6(f"{n}_fsi") for n in names), *(f"{n}_n" for n in names), *(r6(f"{n}_weight") for n in names), r6("mu"), r6("sigma"))


def recommend_mean(spark, d):
    return recommend.by_mean(_weighted(spark, d), WANTED).orderBy(F.desc(F.round("score", 9)), "place").limit(3).select("place", r6("score"))


def recommend_nonneutral(spark, d):
    return recommend.by_told_mean(_weighted(spark, d), WANTED).select("place", r6("score"))


def _legacy(spark, d):
    named = F.when(F.col("factor") == "f0", "형태성").when(F.col("factor") == "f1", "사회성").when(F.col("factor") == "f2", "참여성").otherwise(F.col("factor"))
    return op.current_factors(_weighted(spark, d).withColumn("factor", named))


def legacy_factor_merge(spark, d):
    return _legacy(spark, d).select("place", "factor", "n", r6("fsi"), r6("weight"))


def top_reviews_per_factor(spark, d):
    return op.top_reviews(_reviews(spark, d)).select("factor", "place", "review", "rank", r6("similarity"))


def top_decile_places(spark, d):
    return op.top_share(op.fsi(_reviews(spark, d), b.place_grid(spark, d))).select("factor", "place", r6("fsi"))


def text_vs_image(spark, d):
    scores = op.fsi(_reviews(spark, d), b.place_grid(spark, d))
    told = scores.where("factor in ('f0', 'f1', 'f2')").groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("factor", F.struct((F.col("place") * 0.07).cast("string").alias("score"), F.lit("x").alias("confidence"), F.lit("false").alias("insufficient"))))).alias("factors"))
    images = mapping.image_answer(told, [n for _, n in b.VECTOR_FACTORS])
    return op.compared(scores, images).select("place", "factor", r6("text_score"), r6("image_score"), r6("difference"))


def score_audit(spark, d):
    fixes = spark.createDataFrame([("f0", "0.3"), ("f4", "-0.4"), ("f9", "oops"), ("zz", "0.1")], "factor string, delta string")
    return op.audited(_weighted(spark, d), fixes)[0].select("place", "factor", r6("fsi"))


def score_audit_log(spark, d):
    fixes = spark.createDataFrame([("f0", "0.3", "quiet"), ("f4", "-0.4", None), ("f9", "oops", "x"), ("zz", "0.1", "y")], "factor string, delta string, reason string")
    return op.audited(_weighted(spark, d), fixes)[1].select("place", "factor", "original", "adjusted", "delta", "reason")


def blended_scores(spark, d):
    """Similarity and sentiment blended per sentence, keyword boosts per place, means per place."""
    similar = _similar(spark, d)
    values = similar.withColumn("value", blended(F.col("similarity") * 1.5, F.col("sentiment"))).groupBy("place", "factor").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    hits = (F.col("place") % 3).cast("int")
    boost = F.when(F.col("factor") == "f1", keyword_boost(hits))
    minutes = F.when((F.col("factor") == "f3") & (F.col("place") % 2 == 0), 0.9)
    return values.select("place", "factor", r6(boosted(F.col("total"), F.col("n"), boost, minutes), "score"))


def blended_review_default(spark, d):
    """Per review and factor the blended mean, neutral without any, then the mean over reviews: the default
    enters at the review and so draws the mean."""
    values = _similar(spark, d).withColumn("value", blended(F.col("similarity") * 1.5, F.col("sentiment")))
    per_review = values.groupBy("place", "review", "factor").agg(F.coalesce(F.avg("value"), F.lit(0.5)).alias("v"))
    per_place = per_review.groupBy("place", "factor").agg(F.avg("v").alias("score"))
    return per_place.groupBy("place").agg(r6(F.avg("score"), "placeness"), F.count(F.lit(1)).alias("factors"))


QUERIES = {
    f.__name__: f
    for f in (similarity_long, factor_mentions, review_factor_scores, fsi, weights, mu_sigma, deviant_factors, place_metrics_wide, recommend_mean, recommend_nonneutral, legacy_factor_merge, top_reviews_per_factor, top_decile_places, text_vs_image, score_audit, score_audit_log, blended_scores, blended_review_default)
}

W = f"WITH {b.VECTORS_SQL}"
_NAMES = [n for _, n in b.VECTOR_FACTORS]
_wide = lambda c, n: f"max({c}) FILTER (factor = '{n}')"
_blend = "CASE WHEN greatest(0, least(1, similarity * 1.5)) > 0.3 THEN 0.75::DOUBLE * greatest(0, least(1, similarity * 1.5)) + 0.25::DOUBLE * sentiment END"
ORACLE_SQL = {
    "similarity_long": f"{W} SELECT sentence, factor, {s6('similarity')} FROM sims",
    "factor_mentions": f"{W} SELECT place, review, sentence, factor, {s6('similarity')}, {s6('sentiment')} FROM mentions",
    "review_factor_scores": f"{W} SELECT place, review, factor, sentences, {s6('review_score')}, {s6('similarity')} FROM review_scores",
    "fsi": f"{W} SELECT place, factor, n, {s6('fsi')} FROM fsi",
    "weights": f"{W} SELECT place, factor, {s6('weight')} FROM weighted",
    "mu_sigma": f"{W} SELECT place, {s6('mu')}, {s6('sigma')} FROM mu",
    "deviant_factors": f"""{W} SELECT place, coalesce(string_agg(factor, ', ' ORDER BY factor_order) FILTER (n > 0 AND fsi >= mu + 0.05 - 1e-9), '') AS strong,
        coalesce(string_agg(factor, ', ' ORDER BY factor_order) FILTER (n > 0 AND fsi <= mu - 0.05 + 1e-9), '') AS weak, round((first(mu)) + 1e-10::DOUBLE, 6) + 0.0 AS mu FROM weighted JOIN mu USING (place) GROUP BY place""",
    "place_metrics_wide": f"""{W} SELECT place, {", ".join(f"round(({_wide('fsi', n)}) + 1e-10::DOUBLE, 6) + 0.0 AS {n}_fsi, {_wide('n', n)} AS {n}_n, round(({_wide('weight', n)}) + 1e-10::DOUBLE, 6) + 0.0 AS {n}_weight" for n in _NAMES)},
        round((first(mu)) + 1e-10::DOUBLE, 6) + 0.0 AS mu, round((first(sigma)) + 1e-10::DOUBLE, 6) + 0.0 AS sigma FROM weighted JOIN mu USING (place) GROUP BY place""",
    "recommend_mean": f"{W} SELECT place, {s6('score')} FROM (SELECT place, avg(fsi) AS score FROM weighted WHERE factor IN ('f0', 'f3', 'f7') GROUP BY place) ORDER BY round(score, 9) DESC, place LIMIT 3",
    "recommend_nonneutral": f"{W} SELECT place, {s6('score')} FROM (SELECT place, coalesce(avg(nullif(fsi, 0.5)), 0) AS score FROM weighted WHERE factor IN ('f0', 'f3', 'f7') GROUP BY place) WHERE score > 0",
    "legacy_factor_merge": f"""{W} SELECT place, CASE factor WHEN 'f0' THEN '개방성' WHEN 'f1' THEN '상호작용성' WHEN 'f2' THEN '상호작용성' ELSE factor END AS factor, CAST(sum(n) AS BIGINT) AS n,
        round((avg(fsi)) + 1e-10::DOUBLE, 6) + 0.0 AS fsi, round((least(sum(weight), 1.0)) + 1e-10::DOUBLE, 6) + 0.0 AS weight FROM weighted GROUP BY 1, 2""",
    "top_reviews_per_factor": f"""{W} SELECT factor, place, review, CAST(rank AS INT) AS rank, {s6("similarity")} FROM
        (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY round(similarity, 9) DESC, place, review) AS rank FROM review_scores) WHERE rank <= 10""",
    "top_decile_places": f"{W}, q AS (SELECT factor, quantile_cont(fsi, 0.9) AS cut FROM fsi GROUP BY factor) SELECT factor, place, {s6('fsi')} FROM fsi JOIN q USING (factor) WHERE round(fsi, 9) >= round(cut, 9)",
    "text_vs_image": f"""{W}, i AS (SELECT place, factor, fsi, CASE WHEN factor IN ('f0', 'f1', 'f2') THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, place * 0.07::DOUBLE)) ELSE 0.5::DOUBLE END AS image FROM fsi)
        SELECT place, factor, round((fsi) + 1e-10::DOUBLE, 6) + 0.0 AS text_score, round((image) + 1e-10::DOUBLE, 6) + 0.0 AS image_score, round((image - fsi) + 1e-10::DOUBLE, 6) + 0.0 AS difference FROM i""",
    "score_audit": f"""{W} SELECT place, factor, round((CASE factor WHEN 'f0' THEN greatest(0.2, least(1.0, fsi + 0.3)) WHEN 'f4' THEN greatest(0.2, least(1.0, fsi - 0.4)) ELSE fsi END) + 1e-10::DOUBLE, 6) + 0.0 AS fsi FROM weighted""",
    "score_audit_log": f"""{W}, c(factor, delta, reason) AS (VALUES ('f0', 0.3::DOUBLE, 'quiet'), ('f4', -0.4::DOUBLE, ''))
        SELECT place, factor, round(fsi, 2) AS original, round(greatest(0.2, least(1.0, fsi + delta)), 2) AS adjusted, round(delta, 2) AS delta, reason FROM weighted JOIN c USING (factor)""",
    "blended_scores": f"""{W}, v AS (SELECT place, factor, {_blend} AS value FROM sims),
        s AS (SELECT place, factor, coalesce(sum(value), 0) AS total, count(value) AS n,
              CASE WHEN factor = 'f1' AND place % 3 > 0 THEN least(0.75::DOUBLE + 0.05::DOUBLE * (place % 3), 0.95) END AS k, CASE WHEN factor = 'f3' AND place % 2 = 0 THEN 0.9::DOUBLE END AS m FROM v GROUP BY place, factor)
        SELECT place, factor, round(((total + CASE WHEN k IS NULL THEN 0 ELSE 3 * k END + CASE WHEN m IS NULL THEN 0 ELSE 5 * m END)
            / nullif(n + CASE WHEN k IS NULL THEN 0 ELSE 3 END + CASE WHEN m IS NULL THEN 0 ELSE 5 END, 0)) + 1e-10::DOUBLE, 6) + 0.0 AS score FROM s""",
    "blended_review_default": f"""{W}, r AS (SELECT place, review, factor, coalesce(avg({_blend}), 0.5) AS v FROM sims GROUP BY ALL), p AS (SELECT place, factor, avg(v) AS score FROM r GROUP BY ALL)
        SELECT place, round((avg(score)) + 1e-10::DOUBLE, 6) + 0.0 AS placeness, count(*) AS factors FROM p GROUP BY place""",
}
