"""Queries on Korean reviews, which the driver's tables lack: a review's number picks one of these texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DISTRICTS, FACTOR_KEYWORDS, FACTOR_ORDER, NEGATIVE_WORDS, POSITIVE_WORDS, PRESETS, STOP_WORDS
from ..functions import sentiment as fs
from ..functions import text as ft
from ..functions.vectors import keyword_boost
from ..operators import evidence as op
from ..operators import keywords, recommend
from ..sources import bindings as b
from .common import r6, s6

TEXTS = [
    "분위기 좋고 조명이 예쁘다. 역에서 5분 거리",
    "도보 12분, 자리가 좁고 시끄럽다! 커피는 맛있어요",
    "직원이 친절하고 좌석 간격이 넓어 작업하기 좋다 abc 123",
    "도보로 3분, 15분 거리에 주차장. 재방문 하고 싶다",
    "별로, 불친절하고 지저분하다 ㅋㅋ",
    "동네 골목의 독특한 컨셉 카페, 정류장까지 8분",
    "only english here",
    "최고의 뷰! 채광이 좋은 테라스, 20분 도보",
]
NAMES = ["스타 벅스 강남구 역삼동", "한옥 카페 마포구", "이름 없는 집", "서초구 반포 지점", "빵집 강남구청 앞", "골목 중구 을지로 중구", "  찻집   용산구  "]
PRESET = "친구와 대화하기 좋은 곳"
#: The factors that stand for the event types.
EVENT_NAMES = dict(zip((n for n, _, _ in b.EVENT_FACTORS), ("개방성", "심미성", "쾌적성", "활동성", "접근성"), strict=True))


def _picked(values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("review") % len(values) + 1).cast("int"))


def _rows(spark, d):
    return b.reviews(spark, d).select("review", _picked(TEXTS).alias("t"))


def korean_districts(spark, d):
    rows = b.reviews(spark, d).select("review", ft.place_parts(_picked(NAMES), F.array(*map(F.lit, DISTRICTS))).alias("p"))
    return rows.select("review", "p.base", "p.district", "p.neighborhood")


def factor_keyword_boost(spark, d):
    rows = _rows(spark, d).select("review", F.inline(ft.factor_hits(F.col("t"))))
    return rows.select("review", "factor", F.col("hits").cast("long").alias("hits"), r6(keyword_boost(F.col("hits")), "boost"))


def walking_minutes_boost(spark, d):
    return _rows(spark, d).select("review", ft.walking_score(F.col("t")).alias("boost")).where("boost is not null")


def korean_lexicon(spark, d):
    return _rows(spark, d).select("review", r6(fs.lexicon_score(F.col("t")), "score"))


def korean_script(spark, d):
    return _rows(spark, d).select("review", ft.hangul_only(F.col("t")).alias("hangul"))


def korean_keywords(spark, d):
    rows = _rows(spark, d).withColumn("place", F.col("review") % 5)
    return keywords.tfidf(rows, "place", "t", STOP_WORDS).select("place", "word", "tf", "df", r6("tfidf"))


def recommend_by_preset(spark, d):
    named = F.element_at(F.create_map(*(F.lit(x) for pair in EVENT_NAMES.items() for x in pair)), F.col("factor"))
    by_factor = op.factor_scores(op.scored(b.events(spark, d).withColumn("factor", named), op.factor_dimension(spark)))
    found = recommend.by_preset(by_factor, op.place_scores(by_factor), PRESET, 5, 20)
    return found.select("place", "matched", "factors", "top_factor", "rank", "evidence_count", r6("score"), r6("placeness_score"))


QUERIES = {f.__name__: f for f in (korean_districts, factor_keyword_boost, walking_minutes_boost, korean_lexicon, korean_script, korean_keywords, recommend_by_preset)}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _held(words) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS BIGINT)" for w in words)


def _walk(phrase: str) -> str:
    return f"regexp_extract_all(t, '{phrase}', 1)"


W = f"WITH {b.REVIEWS_SQL}, k AS (SELECT review, ({_list(TEXTS)})[review % {len(TEXTS)} + 1] AS t FROM reviews)"
ORACLE_SQL = {
    "korean_districts": rf"""WITH {b.REVIEWS_SQL}, n AS (SELECT review, string_split_regex(trim(({_list(NAMES)})[review % {len(NAMES)} + 1]), '\s+') AS w FROM reviews),
        p AS (SELECT review, w, list_filter(w, lambda x: list_contains({_list(DISTRICTS)}, x))[1] AS district FROM n), a AS (SELECT *, list_position(w, district) AS i FROM p)
        SELECT review, CASE WHEN i > 1 THEN array_to_string(list_slice(w, 1, i - 1), ' ') ELSE w[1] END AS base, district, CASE WHEN i < len(w) THEN w[i + 1] END AS neighborhood FROM a""",
    "factor_keyword_boost": f"""{W}, h AS ({" UNION ALL ".join(f"SELECT review, '{f}' AS factor, {_held(words)} AS hits FROM k" for f, words in FACTOR_KEYWORDS.items())})
        SELECT review, factor, hits, {s6("least(0.75::DOUBLE + 0.05::DOUBLE * hits, 0.95)", "boost")} FROM h WHERE hits > 0""",
    "walking_minutes_boost": f"""{W}, m AS (SELECT review, list_concat({", ".join(map(_walk, ft.WALKING_PHRASES))}) AS m FROM k)
        SELECT review, CAST(list_max(list_transform(m, lambda x: CASE WHEN x::INT <= 5 THEN 0.95 WHEN x::INT <= 10 THEN 0.9 WHEN x::INT <= 15 THEN 0.85 ELSE 0.8 END)) AS DOUBLE) AS boost FROM m WHERE len(m) > 0""",
    "korean_lexicon": f"{W} SELECT review, {s6(f'greatest(0.05, least(0.95, 0.5 + 0.12::DOUBLE * ({_held(POSITIVE_WORDS)}) - 0.12::DOUBLE * ({_held(NEGATIVE_WORDS)})))', 'score')} FROM k",
    "korean_script": rf"{W} SELECT review, regexp_replace(t, '[^가-힣\s]', '', 'g') AS hangul FROM k",
    "korean_keywords": rf"""{W}, w AS (SELECT review % 5 AS place, unnest(regexp_extract_all(lower(t), '[\pL\pN_]{{2,}}')) AS word FROM k), tf AS (SELECT place, word, count(*) AS tf FROM w WHERE NOT list_contains({_list(STOP_WORDS)}, word) GROUP BY ALL),
        c AS (SELECT word, count(*) AS df FROM tf GROUP BY word ORDER BY sum(tf) DESC, word LIMIT 1000), r AS (SELECT place, word, tf, df, tf * (ln((1 + (SELECT count(DISTINCT review % 5) FROM k)) / (1 + df)) + 1) AS raw FROM tf JOIN c USING (word)),
        t AS (SELECT place, word, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY place)) AS tfidf FROM r) SELECT place, word, tf, df, {s6("tfidf")} FROM t""",
    "recommend_by_preset": f"""WITH {b.EVENTS_SQL.replace("user_id AS place, event_type AS factor", "user_id AS place, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in EVENT_NAMES.items()) + " END AS factor").replace("('click', 0, 'physical'), ('error', 1, 'physical'), ('purchase', 2, 'activity'), ('signup', 3, 'activity'), ('view', 4, 'meaning')", ", ".join(f"('{f}', {i}, 'x')" for i, f in enumerate(FACTOR_ORDER)))},
        own AS (SELECT * FROM fsw WHERE list_contains({_list(PRESETS[PRESET])}, factor)),
        top AS (SELECT place, factor AS top_factor FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(factor_score, 9) DESC, mention_count DESC, factor_order) AS n FROM own) WHERE n = 1),
        s AS (SELECT place, avg(factor_score) AS score, count(*) AS matched, string_agg(factor, ', ' ORDER BY factor_order) AS factors FROM own GROUP BY place),
        r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, matched DESC, round(placeness_score, 9) DESC, place) AS rank FROM s JOIN top USING (place) JOIN ps USING (place) WHERE evidence_count >= 5)
        SELECT place, matched, factors, top_factor, CAST(rank AS INT) AS rank, evidence_count, {s6("score")}, {s6("placeness_score")} FROM r WHERE rank <= 20""",
}
