"""The driver's tables under the names of the operators: one binding, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FACTOR_ORDER
from ..functions.sentiment import label_of, lexicon_score
from .kept import spread

# The factor dimension of the event tables, in alphabetical order.
EVENT_FACTORS = [("click", 0, "physical"), ("error", 1, "physical"), ("purchase", 2, "activity"), ("signup", 3, "activity"), ("view", 4, "meaning")]
PART_FACTORS = [(n, i, ("physical", "activity", "meaning")[i // 2]) for i, n in enumerate(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])]
#: Words of the generated texts that stand for the lexicon's.
POSITIVE, NEGATIVE = ["that", "than", "avec", "nicht"], ["this", "from", "dans"]
#: The cut that fits nearly orthogonal vectors.
CUT = 0.2
VECTOR_FACTORS = [(i, f"f{i}") for i in range(len(FACTOR_ORDER))]


#: Tables whose rows are work enough to deal them out.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(read) if name in TEXTS else read


def dimension(spark: SparkSession, rows=EVENT_FACTORS) -> DataFrame:
    return spark.createDataFrame(rows, "factor string, factor_order int, category string")


def events(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    hint = F.when(v >= 60, "positive").when(v >= 30, "mixed").when(v >= 15, "neutral").otherwise("negative")
    return table(spark, d, "events").select(
        F.col("user_id").alias("place"),
        F.col("event_type").alias("factor"),
        hint.alias("hint"),
        (F.get_json_object("props", "$.k").try_cast("double") / 100).alias("confidence"),
        F.floor(F.col("event_id") / 4).alias("review"),
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("evidence"),
        F.col("event_id").alias("ordinal"),
    )


EVENTS_SQL = """
dim(factor, factor_order, category) AS (VALUES ('click', 0, 'physical'), ('error', 1, 'physical'), ('purchase', 2, 'activity'), ('signup', 3, 'activity'), ('view', 4, 'meaning')),
evidence AS (SELECT user_id AS place, event_type AS factor,
    CASE WHEN value >= 60 THEN 'positive' WHEN value >= 30 THEN 'mixed' WHEN value >= 15 THEN 'neutral' ELSE 'negative' END AS hint,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, event_id // 4 AS review,
    event_type || '-' || CAST(event_id % 7 AS VARCHAR) AS evidence, event_id AS ordinal FROM events),
scored AS (SELECT e.*, d.factor_order, d.category, e.hint AS sentiment,
    CASE e.hint WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_value
    FROM evidence e JOIN dim d USING (factor)),
fs0 AS (SELECT place, factor, count(*) AS mention_count, avg(sentiment_value) AS factor_score, avg(confidence) AS avg_confidence,
    CAST(count_if(sentiment = 'positive') AS BIGINT) AS positive_count, CAST(count_if(sentiment = 'neutral') AS BIGINT) AS neutral_count,
    CAST(count_if(sentiment = 'mixed') AS BIGINT) AS mixed_count, CAST(count_if(sentiment = 'negative') AS BIGINT) AS negative_count,
    min(category) AS category, min(factor_order) AS factor_order FROM scored GROUP BY place, factor),
fs AS (SELECT *, CAST(sum(mention_count) OVER (PARTITION BY place) AS BIGINT) AS total_mentions FROM fs0),
fsw AS (SELECT *, mention_count / total_mentions AS mention_share, factor_score * mention_count / total_mentions AS weighted_score FROM fs),
best AS (SELECT place, factor AS most_mentioned FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY mention_count DESC, factor_score DESC, factor_order) AS n FROM fsw) WHERE n = 1),
ps AS (SELECT place, sum(weighted_score) AS placeness_score, CAST(sum(mention_count) AS BIGINT) AS evidence_count, count(*) AS factor_count,
    avg(factor_score) AS mean_factor_score, CAST(sum(positive_count) AS BIGINT) AS positive_count, CAST(sum(neutral_count) AS BIGINT) AS neutral_count,
    CAST(sum(mixed_count) AS BIGINT) AS mixed_count, CAST(sum(negative_count) AS BIGINT) AS negative_count, avg(avg_confidence) AS avg_confidence,
    CAST(sum(positive_count) AS DOUBLE) / sum(mention_count) AS positive_ratio, CAST(sum(negative_count) AS DOUBLE) / sum(mention_count) AS negative_ratio
    FROM fsw GROUP BY place)
"""


def large_evidence(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_orderkey", "l_linenumber")
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    hint = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("place"), F.col("p_type").alias("factor"), hint.alias("hint"), F.col("l_discount").alias("confidence"), F.lit("").alias("evidence"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """review, place, district, review_text, rating (null where unlabelled)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review"), F.col("source").alias("place"), F.col("lang").alias("district"), F.col("text").alias("review_text"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, F.col("review") == F.col("doc_id"), "left").select("review", "place", "district", "review_text", (F.col("quality") * 4 + 1).alias("rating"))


REVIEWS_SQL = """
reviews AS (SELECT d.doc_id AS review, source AS place, lang AS district, text AS review_text, quality * 4 + 1 AS rating
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)
"""


def lexicon(text) -> object:
    return lexicon_score(text, POSITIVE, NEGATIVE)


LEXICON_SQL = (
    "greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + ("
    + " + ".join(f"CAST(contains(lower({{0}}), '{w}') AS INT)" for w in POSITIVE)
    + ") * 0.12::DOUBLE - ("
    + " + ".join(f"CAST(contains(lower({{0}}), '{w}') AS INT)" for w in NEGATIVE)
    + ") * 0.12::DOUBLE))"
)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Per label the vector with the smallest id: factor, factor_order, vec_id, embedding."""
    vectors = table(spark, d, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v"))
    return first.select(F.concat(F.lit("f"), F.col("label").cast("string")).alias("factor"), F.col("label").alias("factor_order"), "v.vec_id", "v.embedding")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are no anchors, as sentences of reviews of twenty places, with their lexicon score."""
    own = table(spark, d, "embeddings").join(F.broadcast(anchors(spark, d).select("vec_id")), "vec_id", "left_anti")
    text = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), lexicon(F.col("text")).alias("s"))
    review = F.floor(F.col("vec_id") / 10)
    return own.join(text, "vec_id", "left").select((review % 20).alias("place"), review.alias("review"), F.col("vec_id").alias("sentence"), "embedding", F.coalesce("s", F.lit(0.5)).alias("sentiment"))


def place_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every place with every factor."""
    factors = F.array(*(F.struct(F.lit(n).alias("factor"), F.lit(i).alias("factor_order")) for i, n in VECTOR_FACTORS))
    return sentences(spark, d).select("place").distinct().select("place", F.explode(factors).alias("f")).select("place", "f.*")


VECTORS_SQL = f"""
anchors AS (SELECT 'f' || CAST(label AS VARCHAR) AS factor, label AS factor_order, vec_id, embedding FROM
    (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1),
sentences AS (SELECT (e.vec_id // 10) % 20 AS place, e.vec_id // 10 AS review, e.vec_id AS sentence, e.embedding,
    CASE WHEN d.text IS NULL THEN 0.5::DOUBLE ELSE {LEXICON_SQL.format("d.text")} END AS sentiment
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id NOT IN (SELECT vec_id FROM anchors)),
sims AS (SELECT s.place, s.review, s.sentence, s.sentiment, a.factor, a.factor_order,
    list_cosine_similarity(s.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS similarity FROM sentences s CROSS JOIN anchors a),
mentions AS (SELECT * FROM sims WHERE similarity >= {CUT}),
review_scores AS (SELECT place, review, factor, factor_order, avg(sentiment) AS review_score, max(similarity) AS similarity, count(*) AS sentences
    FROM mentions GROUP BY ALL),
grid AS (SELECT place, factor, factor_order FROM (SELECT DISTINCT place FROM sentences) CROSS JOIN
    (SELECT 'f' || CAST(i AS VARCHAR) AS factor, CAST(i AS INT) AS factor_order FROM range(10) t(i))),
fsi AS (SELECT g.place, g.factor, g.factor_order, coalesce(s.fsi, 0.5) AS fsi, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN
    (SELECT place, factor, avg(review_score) AS fsi, count(*) AS n FROM review_scores GROUP BY place, factor) s USING (place, factor)),
weighted AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY place), 0), 0)::DOUBLE AS weight FROM fsi),
mu AS (SELECT place, sum(weight * fsi) AS mu, stddev_pop(fsi) AS sigma FROM weighted GROUP BY place)
"""
