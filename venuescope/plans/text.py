"""Queries over review text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sentiment as fs
from ..functions import text as ft
from ..functions import vectors as fv
from ..operators import keywords, places, similarity, spans
from ..sources import bindings as b
from ..sources import files, kept
from .common import r6, s6

#: Words of the generated texts for keyword boosts, and phrases with numbers for minutes.
BOOST_WORDS = {"f0": ["that", "avec", "nicht"], "f1": ["this", "dans"], "f2": ["from", "para"]}
MINUTES = [r"version (\d+)", r"(\d+)-\d{4}", r"BY-NC (\d+)"]
STOP = ["the", "and", "les", "der", "que", "of"]


def _rows(spark, d):
    return b.reviews(spark, d)


def place_key_clean(spark, d):
    hood = F.when(F.col("review") % 3 == 0, F.concat(F.lit("n"), (F.col("review") % 5).cast("string")))
    rows = places.known_reviews(_rows(spark, d))
    return rows.select("review", ft.place_key(F.col("place"), F.col("district"), hood).alias("place"), F.col("place").alias("original"))


def text_flags(spark, d):
    t = F.coalesce(F.col("rating").cast("string"), F.col("review_text"))
    rows = _rows(spark, d).select("review", t.alias("t"), F.when(F.col("district") == "es", t).alias("author"))
    heading = F.concat(F.lit("음식: "), F.col("t"))
    return rows.select("review", ft.is_number(F.col("t")).alias("number"), ft.is_metadata(heading).alias("metadata"), ft.language(heading).alias("lang"), ft.language(F.col("t")).alias("own_lang"), ft.author_only(F.col("t"), F.col("author")).alias("name_only"))


def review_clean(spark, d):
    t = F.concat(F.lit("지역 가이드 · 리뷰 1,370개 · 사진 34장 2년 전 "), F.col("review_text"), F.lit(" 리뷰 3개 · 3개월 전·ok 리뷰리뷰"))
    return _rows(spark, d).select("review", ft.cleaned(t).alias("clean"))


def review_clean_author(spark, d):
    t = F.concat("place", F.lit(" "), F.col("review_text"), F.lit(" "), F.col("place"), F.lit("2년 전"))
    return _rows(spark, d).select("review", ft.cleaned(t, F.col("place")).alias("clean"))


def scraped_text(spark, d):
    t = F.concat(F.lit("3달 전 "), F.col("review_text"), F.lit("… 자세히 HJ리뷰 2개 · 사진 3장 더보기  end"))
    return _rows(spark, d).select("review", ft.scraped(t).alias("clean"))


def rating_backfill(spark, d):
    t = F.when(F.length("review_text") < 300, F.lit(" ")).when(F.length("review_text") < 600, F.lit("short")).otherwise(F.col("review_text"))
    author = F.when(F.col("district") == "fr", t)
    return _rows(spark, d).select("review", ft.backfilled(t, author, F.col("rating").cast("double")).alias("text"))


def sentences(spark, d):
    return _rows(spark, d).select("review", F.posexplode(ft.sentences(F.col("review_text"))).alias("i", "sentence"))


def sentences_keep_punct(spark, d):
    rows = _rows(spark, d).select("review", F.posexplode(ft.sentences_with_ends(F.col("review_text"))).alias("i", "s"))
    return rows.select("review", "i", ft.capped(F.col("s"), 80).alias("sentence"))


def truncate_text(spark, d):
    return _rows(spark, d).select("review", F.md5(ft.truncated(F.col("review_text")).cast("binary")).alias("cut"), F.length(ft.truncated(F.col("review_text"))).alias("length"))


def compact_text(spark, d):
    return _rows(spark, d).select("review", ft.compact(F.col("review_text")).alias("line"))


def lexicon_sentiment(spark, d):
    t = F.when(F.col("rating") == 5, F.lit("4.5")).when(F.col("rating") == 1, F.lit("서비스: 5")).otherwise(F.col("review_text"))

    def model(text):
        return ft.let(ft.let(b.lexicon(text), fs.lexicon_result), lambda told: fs.normalised(told["label"], told["score"])["score"])

    rows = _rows(spark, d).select("review", fs.routed(t, model, F.when(F.col("district") != "de", F.col("rating"))).alias("score"))
    return rows.select("review", r6("score"), fs.label_of(F.col("score")).alias("label"))


def place_avg_sentiment(spark, d):
    return _rows(spark, d).groupBy("place").agg(r6(F.avg(b.lexicon(F.col("review_text"))), "sentiment"), F.count(F.lit(1)).alias("reviews"))


def sentiment_outer_merge(spark, d):
    rows = _rows(spark, d).select("review", "place", "rating", b.lexicon(F.col("review_text")).alias("s"))
    left = rows.where("s >= 0.5").select("review", "place", r6("s", "sentiment"))
    right = rows.where("rating is not null").select("review", "place", F.length("place").cast("double").alias("size"))
    a, c = left.alias("a"), right.alias("c")
    on = F.col("a.review").eqNullSafe(F.col("c.review")) & F.col("a.place").eqNullSafe(F.col("c.place"))
    return a.join(c, on, "full").select(F.coalesce("a.review", "c.review").alias("review"), F.coalesce("a.place", "c.place").alias("place"), "sentiment", "size")


def keyword_boost(spark, d):
    hits = F.array(*(F.struct(F.lit(f).alias("factor"), ft.keyword_hits(F.col("review_text"), w).alias("hits")) for f, w in BOOST_WORDS.items()))
    rows = _rows(spark, d).select("review", F.explode(hits).alias("h")).select("review", "h.*")
    return rows.where("hits > 0").select("review", "factor", F.col("hits").cast("long").alias("hits"), r6(fv.keyword_boost(F.col("hits")), "boost"))


def minutes_boost(spark, d):
    return _rows(spark, d).select("review", ft.best_minutes(F.col("review_text"), MINUTES).alias("boost")).where("boost is not null")


def tfidf_keywords(spark, d):
    rows = keywords.tfidf(_rows(spark, d), "place", "review_text", STOP)
    return rows.select("place", "word", "tf", "df", r6("tfidf"))


def hybrid_keywords(spark, d):
    rows = keywords.hybrid(_rows(spark, d), "place", "review_text", STOP)
    return rows.select("place", "word", "rank", r6("hybrid"), r6("share"))


def dedup_reviews(spark, d):
    norm = ft.collapse(F.coalesce("review_text", F.lit("")))
    kept = places.first_of_copies(_rows(spark, d), [F.col("place"), F.col("district"), F.substring(norm, 1, 150)], "review", 30, "place")
    return kept.select("review", "place")


def stratified_sample(spark, d):
    return places.stratified(_rows(spark, d), "place", "review", 20).select("review", "place")


def strata_sizes(spark, d):
    kept = places.stratified(_rows(spark, d), "district", "review", 120)
    return kept.groupBy("district").agg(F.count(F.lit(1)).alias("kept"), (F.count(F.lit(1)) < 120).alias("short"))


def resume_by_key(spark, d):
    rows = _rows(spark, d)
    return places.left_to_do(rows, rows.where("rating = 1").select("place", "district"), ["place", "district"]).select("review", "place", "district")


def resume_by_position(spark, d):
    rows = _rows(spark, d)
    return places.after_last(rows, rows.where("rating = 1").select("review"), "review", "review").select("review", "place")


def place_slice(spark, d):
    return places.place_slice(_rows(spark, d), 3, 8, "place", "review").select("review", "place")


def row_numbers(spark, d):
    return places.numbered(places.known_reviews(_rows(spark, d)), "review").select("review", "review_index")


def union_parts(spark, d):
    rows = _rows(spark, d).select("review", "place", "district")
    # The parts of the table as files, as a run over chunks leaves them, read as one.
    folder = kept.own_folder(spark)
    told = rows.withColumnRenamed("review", "review_index")
    paths = [files.write_csv(told.where(where), f"{folder}/part-{n}-{uuid.uuid4().hex}") for n, where in enumerate(("district = 'en'", "district <> 'en' or district is null"))]
    both = files.read_parts(spark, paths).select(F.col("review_index").cast("long").alias("review"), "place")
    return places.in_order(both, "place", "review")


def csv_texts(spark, d):
    """Texts with quotes, commas and line ends, written as CSV and read in byte ranges."""
    path = files.write_csv(_rows(spark, d).select("review", "review_text", "place"), f"{kept.own_folder(spark)}/texts-{uuid.uuid4().hex}")
    return files.read_csv(spark, path).select(F.col("review").cast("long").alias("review"), "place", F.md5(F.col("review_text").cast("binary")).alias("text"))


def sparse_positions(spark, d):
    """Positions by ordinals that are hashed, crowded or missing; of those without one only that they come last."""
    review = F.col("review")
    ordinal = F.when(review % 50 == 0, F.lit(None)).when(review % 3 == 0, review * 1_000_003_000_017 % 998_244_353_111_111).otherwise(review)
    told = places.numbered(_rows(spark, d).select("review", ordinal.cast("long").alias("ordinal")), "ordinal", "at")
    return told.select("review", F.when(F.col("ordinal").isNull(), F.lit(-1)).otherwise(F.col("at")).cast("long").alias("position"))


def empty_only_places(spark, d):
    rows = _rows(spark, d).select(F.concat("place", F.lit("-"), F.floor(F.col("review") / 100).cast("string")).alias("place"), F.when(F.length("review_text") < 1500, F.lit(" ")).otherwise(F.col("review_text")).alias("t"))
    return places.only_blank(rows, "place", "t")


def rating_rules(spark, d):
    return _rows(spark, d).select("review", fs.rating_score(F.col("rating") - (F.col("review") % 3)).alias("score"))


def label_rules(spark, d):
    # Names that models give.
    names = ["POSITIVE", "negative", "LABEL_1", "label_0", "odd", "5 stars", "2 stars", "긍정", "neutral"]
    label = F.element_at(F.array(*map(F.lit, names)), ((F.col("review") % 9) + 1).cast("int"))
    score = (F.col("review") % 10) / 10.0
    own, stars = fs.normalised(label, score), fs.normalised(label, score, True)
    flag = F.element_at(F.array(*map(F.lit, ["true", " Yes ", "0", "T", "no", "1"])), ((F.col("review") % 6) + 1).cast("int"))
    rows = _rows(spark, d).select("review", own.alias("o"), stars.alias("s"), ft.is_true(flag).alias("flag"))
    return rows.select("review", F.col("o.label").alias("label"), r6(F.col("o.score"), "score"), F.col("s.label").alias("star_label"), r6(F.col("s.score"), "star_score"), "flag")


def script_filter(spark, d):
    return _rows(spark, d).select("review", F.regexp_replace("review_text", r"[^A-Za-z\s]", "").alias("latin"), ft.hangul_only(F.lit("abc 한글 1")).alias("hangul"))


def search_query(spark, d):
    return _rows(spark, d).select("review", ft.search_query(F.col("place"), F.when(F.col("review") % 2 == 0, F.col("district")), F.lit(" ")).alias("query"))


def fingerprint(spark, d):
    return _rows(spark, d).select("review", ft.content_fingerprint(F.col("place"), F.col("district"), F.col("rating"), F.col("review_text")).alias("sha1"))


def data_url(spark, d):
    return _rows(spark, d).select("review", ft.data_url(F.col("review_text").cast("binary")).alias("url"))


def district_parse(spark, d):
    words = F.array(*map(F.lit, ["en", "fr", "de", "es"]))
    name = F.concat_ws(" ", F.lit("Cafe"), F.col("place"), F.when(F.col("review") % 4 != 0, F.col("district")), F.when(F.col("review") % 3 == 0, F.lit("old town")))
    rows = _rows(spark, d).select("review", ft.place_parts(name, words).alias("p"))
    return rows.select("review", "p.base", "p.district", "p.neighborhood")


def tiered_place_match(spark, d):
    points = b.table(spark, d, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") % 40).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " east").otherwise("")).alias("k_name"), F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "es"])), ((F.col("s_suppkey") % 4) + 1).cast("int")).alias("k_district"), F.concat(F.lit("n"), (F.col("s_suppkey") % 2).cast("string")).alias("k_neighborhood"), F.col("s_suppkey").alias("ordinal"), F.col("s_acctbal").alias("lat"), F.col("s_acctbal").alias("lng"))
    own = _rows(spark, d).select(F.col("review").alias("place"), F.col("place").alias("name"), "district", F.when(F.col("review") % 2 == 0, F.concat(F.lit("n"), (F.floor(F.col("review") / 2) % 2).cast("string"))).alias("neighborhood"))
    return places.matched(own, points).select("place", F.col("tier").cast("double").alias("tier"), F.col("match").cast("double").alias("match"))


def district_lookup(spark, d):
    rows = _rows(spark, d)
    known = rows.select(F.concat("place", F.when(F.col("place").isin("src3", "src14"), " x").otherwise("")).alias("k_place"), "district", F.col("review").alias("ordinal"))
    names = rows.select(F.concat("place", F.when(F.col("review") % 2 == 0, F.lit(" east")).otherwise("")).alias("place")).unionByName(spark.createDataFrame([("nowhere at all",)], "place string"))
    return places.districts_of(names, known).withColumn("tier", F.col("tier").cast("double"))


def row_slice(spark, d):
    return places.row_slice(_rows(spark, d), 40, 90, "review").select("review", "place")


def group_evaluation(spark, d):
    rows = _rows(spark, d)
    n = F.size(ft.sentences(F.col("review_text")))
    told = rows.groupBy("place", "district").agg(F.count_if(ft.strip(F.col("review_text")) != "").alias("reviews"), F.sum(n).alias("sentences"), r6(F.avg("rating"), "rating"), r6(F.avg(b.lexicon(F.col("review_text"))), "sentiment"))
    texts = places.joined_md5(rows, ["place", "district"], "review_text", "review", "texts").toDF("own_place", "own_district", "texts")
    same = F.col("place").eqNullSafe(F.col("own_place")) & F.col("district").eqNullSafe(F.col("own_district"))
    return told.join(texts, same, "left").drop("own_place", "own_district")


def char_ngram_cosine(spark, d):
    """Cosine of two texts' character n-gram counts, exactly: what hashed vectors come near to."""
    rows = _rows(spark, d).select("review", F.lower("review_text").alias("t"))
    return similarity.next_cosine(rows, "review", "t").select("review", r6("cosine"))


def hash_encode(spark, d):
    v = fv.hash_encoded_arrow(F.col("review_text"))
    rows = _rows(spark, d).select("review", v.alias("v"))
    return rows.select("review", F.size(F.filter("v", lambda x: x > 0)).alias("filled"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


def _own_words(spark, d):
    """Reviews with three of their own words as evidence."""
    rows = _rows(spark, d).select("review", "review_text")
    return rows.withColumn("evidence", F.array(ft.strip(F.array_join(F.slice(F.split("review_text", r"\s+"), 2, 3), " "))))


def evidence_spans_exact(spark, d):
    return spans.evidence_spans(_own_words(spark, d)).where("tier = 'exact'")


def evidence_spans_spaced(spark, d):
    """Evidence whose words stand apart otherwise than in the text, so that only the second search finds it."""
    rows = _rows(spark, d).select("review", "review_text")
    apart = F.array_join(F.slice(F.filter(F.split("review_text", r"[ \n]+"), lambda w: w != ""), 2, 4), "   \n ")
    return spans.evidence_spans(rows.withColumn("evidence", F.array(apart))).where("tier = 'spaced'")


def highlighted_text(spark, d):
    rows = _own_words(spark, d).where(F.contains("review_text", F.element_at("evidence", 1)))
    return spans.highlighted(rows).select("review", F.md5(F.col("html").cast("binary")).alias("html"))


def evidence_spans(spark, d):
    rows = _rows(spark, d).select("review", "review_text")
    words = F.split("review_text", r"\s+")
    part = lambda i, n: F.array_join(F.slice(words, i, n), " ")
    # One text as it stands, one without its spaces, one that lacks a word.
    evidence = F.array(part(2, 3), F.replace(part(6, 2), F.lit(" "), F.lit("")), F.concat_ws(" ", part(10, 3), part(14, 2)))
    # The same of shorter texts, as far as their words go.
    n = F.size(words)
    short = F.array(
        part(1, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))),
        F.when(n >= 4, F.replace(part(F.floor(n / 2).cast("int") + 1, 2), F.lit(" "), F.lit(""))),
        F.when(n >= 8, F.concat_ws(" ", part(F.greatest(F.lit(1), n - 4), 3), part(n, 1))),
    )
    return spans.evidence_spans(rows.select("review", "review_text", F.when(n > 16, evidence).otherwise(short).alias("evidence")))


QUERIES = {
    f.__name__: f
    for f in (place_key_clean, text_flags, review_clean, review_clean_author, scraped_text, rating_backfill, sentences, sentences_keep_punct, truncate_text, compact_text, lexicon_sentiment, place_avg_sentiment, sentiment_outer_merge, keyword_boost, minutes_boost, tfidf_keywords, hybrid_keywords, dedup_reviews, stratified_sample, strata_sizes, resume_by_key, resume_by_position, place_slice, row_numbers, union_parts, csv_texts, sparse_positions, empty_only_places, rating_rules, label_rules, script_filter, search_query, fingerprint, data_url, district_parse, tiered_place_match, district_lookup, row_slice, group_evaluation, char_ngram_cosine, hash_encode, evidence_spans, evidence_spans_exact, evidence_spans_spaced, highlighted_text)
}

W = f"WITH {b.REVIEWS_SQL}"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_strip, _collapse = STRIP.format, COLLAPSE.format
_hits = lambda words: " + ".join(f"CAST(contains(review_text, '{w}') AS BIGINT)" for w in words)
TF_SQL = r""", w AS (SELECT place, unnest(regexp_extract_all(lower(review_text), '[\pL\pN_]{2,}')) AS word FROM reviews),
k AS (SELECT * FROM w WHERE word NOT IN ('the', 'and', 'les', 'der', 'que', 'of')), tf AS (SELECT place, word, count(*) AS tf FROM k GROUP BY ALL),
c AS (SELECT word, count(*) AS df FROM tf GROUP BY word ORDER BY sum(tf) DESC, word LIMIT 1000),
r AS (SELECT place, word, tf, df, tf * (ln((1 + (SELECT count(DISTINCT place) FROM reviews)) / (1 + df)) + 1) AS raw FROM tf JOIN c USING (word)),
t AS (SELECT place, word, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY place)) AS tfidf FROM r)"""
OWN_WORDS_SQL = rf"""{W}, own AS (SELECT review, review_text AS t, {STRIP.format("array_to_string(list_slice(string_split_regex(review_text, '@S+'), 2, 4), ' ')").replace('@S', chr(92) + 's')} AS e FROM reviews)"""
HTML_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
ORACLE_SQL = {
    "place_key_clean": f"""{W} SELECT review, CASE WHEN district IS NOT NULL AND review % 3 = 0 THEN place || ' ' || district || ' n' || CAST(review % 5 AS VARCHAR) ELSE place END AS place, place AS original
        FROM reviews WHERE place IS NOT NULL AND {_strip("review_text")} <> ''""",
    "text_flags": rf"""{W}, t AS (SELECT review, coalesce(CAST(rating AS VARCHAR), review_text) AS t, CASE WHEN district = 'es' THEN coalesce(CAST(rating AS VARCHAR), review_text) END AS author FROM reviews),
        s AS (SELECT review, t, '음식: ' || t AS h, {_strip("coalesce(t, '')")} AS own, {_strip("coalesce(author, '')")} AS name FROM t)
        SELECT review, coalesce(regexp_matches({_strip("t")}, '^[0-9]+(\.[0-9]+)?$'), false) AS number,
        coalesce(regexp_matches({_strip("h")}, '^(서비스.*식사.*유형|식사.*유형|서비스.*매장.*내.*식사|음식:\s*\d+.*서비스:\s*\d+.*분위기:\s*\d+$|(음식|서비스|분위기):\s*\d+$)'), false) AS metadata,
        CASE WHEN regexp_matches(h, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang, CASE WHEN regexp_matches(t, '[가-힣]') THEN 'ko' ELSE 'en' END AS own_lang,
        (name <> '' AND own = name) OR (name = '' AND length(own) <= 10 AND NOT regexp_matches(replace(own, '.', ''), '^\d+$')) AS name_only FROM s""",
    "sentences": rf"""{W}, s AS (SELECT review, {_strip("review_text")} AS t FROM reviews),
        p AS (SELECT review, t, list_filter(list_transform(string_split_regex(t, '[.!?]\s+'), lambda x: {_strip("x")}), lambda x: length(x) > 1) AS a FROM s WHERE t <> ''),
        q AS (SELECT review, CASE WHEN len(a) = 0 THEN [t] ELSE a END AS a FROM p) SELECT review, CAST(generate_subscripts(a, 1) - 1 AS INT) AS i, unnest(a) AS sentence FROM q""",
    "sentences_keep_punct": rf"""{W}, s AS (SELECT review, {_collapse("review_text")} AS t FROM reviews),
        p AS (SELECT review, t, list_filter(string_split(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 1) AS a FROM s WHERE t <> ''),
        q AS (SELECT review, CASE WHEN len(a) = 0 THEN [t] ELSE a END AS a FROM p),
        e AS (SELECT review, CAST(generate_subscripts(a, 1) - 1 AS INT) AS i, trim(unnest(a)) AS s FROM q)
        SELECT review, i, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 80)) || '...' ELSE s END AS sentence FROM e""",
    "review_clean": rf"""{W}, a AS (SELECT review, '지역 가이드 · 리뷰 1,370개 · 사진 34장 2년 전 ' || review_text || ' 리뷰 3개 · 3개월 전·ok 리뷰리뷰' AS t FROM reviews),
        s AS (SELECT review, regexp_replace({_strip("t")}, '지역\s*가이드\s*·?\s*', '', 'g') AS t FROM a),
        c AS (SELECT review, regexp_replace(regexp_replace(t, '·?\s*리뷰\s*\d+[,.]?\d*\s*개\s*·?\s*', '', 'g'), '·?\s*사진\s*\d+[,.]?\d*\s*장\s*·?\s*', '', 'g') AS t FROM s),
        m AS (SELECT review, regexp_replace(regexp_replace(regexp_replace(t, '\s*·\s*', ' ', 'g'), '[리뷰]{{2,}}|[사진]{{2,}}', '', 'g'), '수정일:\s*', '', 'g') AS t FROM c),
        y AS (SELECT review, regexp_replace(regexp_replace(t, '\d+\s*년\s*전', '', 'g'), '\d+\s*개월\s*전', '', 'g') AS t FROM m),
        z AS (SELECT review, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\d+\s*주\s*전', '', 'g'), '\d+\s*일\s*전', '', 'g'), '\d+\s*시간\s*전', '', 'g'), '\d+\s*분\s*전', '', 'g') AS t FROM y)
        SELECT review, {_collapse("t")} AS clean FROM z""",
    # The name in front goes. The date at the end goes first, with the digits that the name before it ends in.
    "review_clean_author": f"""{W} SELECT review, {_collapse("review_text || ' ' || regexp_replace(place, '[0-9]+$', '')")} AS clean FROM reviews""",
    "scraped_text": rf"""{W}, a AS (SELECT review, '3달 전 ' || review_text || '… 자세히 HJ리뷰 2개 · 사진 3장 더보기  end' AS t FROM reviews),
        s AS (SELECT review, {_strip("replace(replace(replace(replace(t, '자세히', ''), '공유', ''), '더보기', ''), '…', '')")} AS t FROM a),
        c AS (SELECT review, regexp_replace(regexp_replace(regexp_replace(t, '\S*리뷰\s*\d+\s*개\s*·\s*사진\s*\d+\s*장\s*', '', 'g'), '^\d+\s*(년|달|주|일|시간|분)\s*전\s*', ''), '[\x{{2000}}-\x{{206F}}\x{{2E00}}-\x{{2E7F}}]', '', 'g') AS t FROM s)
        SELECT review, {_collapse("t")} AS clean FROM c""",
    "rating_backfill": rf"""{W}, a AS (SELECT review, rating, CASE WHEN length(review_text) < 300 THEN ' ' WHEN length(review_text) < 600 THEN 'short' ELSE review_text END AS t, district FROM reviews),
        b AS (SELECT *, CASE WHEN district = 'fr' THEN t END AS author FROM a),
        s AS (SELECT *, {_strip("t")} AS own, {_strip("coalesce(author, '')")} AS name FROM b)
        SELECT review, CASE WHEN rating IS NOT NULL AND (own = '' OR (name <> '' AND own = name) OR (name = '' AND length(own) <= 10 AND NOT regexp_matches(replace(own, '.', ''), '^\d+$'))) THEN CAST(rating AS VARCHAR) ELSE t END AS text FROM s""",
    "truncate_text": rf"""{W}, s AS (SELECT review, {_strip("review_text")} AS t FROM reviews), h AS (SELECT review, t, substr(t, 1, 2000) AS h FROM s),
        l AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' ') > 0 THEN 2000 - instr(reverse(h), ' ') ELSE -1 END, CASE WHEN instr(reverse(h), '.') > 0 THEN 2000 - instr(reverse(h), '.') ELSE -1 END,
              CASE WHEN instr(reverse(h), chr(10)) > 0 THEN 2000 - instr(reverse(h), chr(10)) ELSE -1 END) AS cut FROM h),
        o AS (SELECT review, CASE WHEN length(t) <= 2000 THEN t WHEN cut > 1600 THEN substr(h, 1, cut + 1) ELSE h END AS x FROM l) SELECT review, md5(x) AS cut, CAST(length(x) AS INT) AS length FROM o""",
    "compact_text": rf"""{W}, s AS (SELECT review, {_collapse("review_text")} AS t FROM reviews) SELECT review, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 119)) || '...' END AS line FROM s""",
    "lexicon_sentiment": rf"""{W}, a AS (SELECT review, CASE WHEN district <> 'de' THEN rating END AS rating, rating = 1 AS heading, CASE rating WHEN 5 THEN '4.5' WHEN 1 THEN '서비스: 5' ELSE review_text END AS t FROM reviews),
        h AS (SELECT review, rating, heading, t, substr({_strip("t")}, 1, 2000) AS h FROM a),
        l AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' ') > 0 THEN 2000 - instr(reverse(h), ' ') ELSE -1 END, CASE WHEN instr(reverse(h), '.') > 0 THEN 2000 - instr(reverse(h), '.') ELSE -1 END, CASE WHEN instr(reverse(h), chr(10)) > 0 THEN 2000 - instr(reverse(h), chr(10)) ELSE -1 END) AS cut FROM h),
        c AS (SELECT review, rating, heading, t, CASE WHEN length({_strip("t")}) <= 2000 THEN h WHEN cut > 1600 THEN substr(h, 1, cut + 1) ELSE h END AS x FROM l),
        s AS (SELECT review, rating, heading, t, {b.LEXICON_SQL.format(_collapse("x"))} AS s FROM c),
        r AS (SELECT review, CASE WHEN regexp_matches({_strip("t")}, '^[0-9]+(\.[0-9]+)?$') THEN CASE WHEN t::DOUBLE >= 4 THEN 0.9 WHEN t::DOUBLE >= 3 THEN 0.5 ELSE 0.1 END::DOUBLE
            WHEN heading THEN CASE WHEN rating >= 4 THEN 0.9 WHEN rating >= 3 THEN 0.5 WHEN rating IS NOT NULL THEN 0.1 ELSE 0.5 END::DOUBLE
            WHEN s >= 0.6 OR s <= 0.4 THEN s ELSE 0.5 END AS score FROM s)
        SELECT review, {s6("score")}, CASE WHEN score >= 0.6 THEN 'positive' WHEN score <= 0.4 THEN 'negative' ELSE 'neutral' END AS label FROM r""",
    "place_avg_sentiment": f"{W} SELECT place, round((avg({b.LEXICON_SQL.format('review_text')})) + 1e-10::DOUBLE, 6) + 0.0 AS sentiment, count(*) AS reviews FROM reviews GROUP BY place",
    "sentiment_outer_merge": f"""{W}, r AS (SELECT review, place, rating, round(({b.LEXICON_SQL.format("review_text")}) + 1e-10::DOUBLE, 6) + 0.0 AS s FROM reviews)
        SELECT coalesce(a.review, c.review) AS review, coalesce(a.place, c.place) AS place, a.s AS sentiment, c.size FROM (SELECT * FROM r WHERE s >= 0.5) a
        FULL JOIN (SELECT review, place, CAST(length(place) AS DOUBLE) AS size FROM r WHERE rating IS NOT NULL) c ON a.review = c.review AND a.place = c.place""",
    "keyword_boost": f"""{W}, h AS ({" UNION ALL ".join(f"SELECT review, '{f}' AS factor, {_hits(w)} AS hits FROM reviews" for f, w in BOOST_WORDS.items())})
        SELECT review, factor, hits, round((least(0.75::DOUBLE + 0.05::DOUBLE * hits, 0.95)) + 1e-10::DOUBLE, 6) + 0.0 AS boost FROM h WHERE hits > 0""",
    "minutes_boost": rf"""{W}, m AS (SELECT review, list_concat(regexp_extract_all(review_text, 'version (\d+)', 1), regexp_extract_all(review_text, '(\d+)-\d{{4}}', 1), regexp_extract_all(review_text, 'BY-NC (\d+)', 1)) AS m FROM reviews)
        SELECT review, CAST(list_max(list_transform(m, lambda x: CASE WHEN x::INT <= 5 THEN 0.95 WHEN x::INT <= 10 THEN 0.9 WHEN x::INT <= 15 THEN 0.85 ELSE 0.8 END)) AS DOUBLE) AS boost FROM m WHERE len(m) > 0""",
    "tfidf_keywords": f"{W}{TF_SQL} SELECT place, word, tf, df, {s6('tfidf')} FROM t",
    "hybrid_keywords": rf"""{W}{TF_SQL}, p AS (SELECT place, word, count(*) AS n FROM (SELECT place, unnest(list_filter(string_split_regex(review_text, '\s+'), lambda x: x <> '')) AS word FROM reviews) GROUP BY ALL),
        sh AS (SELECT place, word, n / sum(n) OVER (PARTITION BY place) AS share FROM p),
        h AS (SELECT t.place, t.word, coalesce(share, 0)::DOUBLE AS share, tfidf * (1 + 2 * coalesce(share, 0)) AS hybrid FROM t LEFT JOIN sh ON t.place = sh.place AND t.word = sh.word),
        o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(hybrid, 9) DESC, word) AS rank FROM h) SELECT place, word, CAST(rank AS INT) AS rank, {s6("hybrid")}, {s6("share")} FROM o WHERE rank <= 15""",
    "dedup_reviews": f"""{W}, k AS (SELECT review, place, row_number() OVER (PARTITION BY place, district, substr({_collapse("review_text")}, 1, 150) ORDER BY review) AS n FROM reviews),
        c AS (SELECT review, place, row_number() OVER (PARTITION BY place ORDER BY review) AS n FROM k WHERE n = 1) SELECT review, place FROM c WHERE n <= 30""",
    "stratified_sample": f"{W} SELECT review, place FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY md5('42:' || CAST(review AS VARCHAR)), review) AS n FROM reviews) WHERE n <= 20",
    "strata_sizes": f"{W} SELECT district, least(count(*), 120) AS kept, count(*) < 120 AS short FROM reviews GROUP BY district",
    "resume_by_key": f"{W} SELECT review, place, district FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM reviews q WHERE q.rating = 1 AND q.place = r.place AND q.district = r.district)",
    "resume_by_position": f"{W} SELECT review, place FROM reviews WHERE review > (SELECT coalesce(max(review), -1) FROM reviews WHERE rating = 1)",
    "place_slice": f"{W}, f AS (SELECT place, row_number() OVER (ORDER BY min(review)) AS n FROM reviews GROUP BY place) SELECT review, place FROM reviews SEMI JOIN (SELECT place FROM f WHERE n > 3 AND n <= 8) USING (place)",
    "row_numbers": f"{W} SELECT review, row_number() OVER (ORDER BY review) - 1 AS review_index FROM reviews WHERE place IS NOT NULL AND {_strip('review_text')} <> ''",
    "union_parts": f"{W} SELECT place, min(review) AS first FROM reviews GROUP BY place",
    "csv_texts": f"{W} SELECT review, place, md5(review_text) AS text FROM reviews",
    "sparse_positions": f"""{W}, o AS (SELECT review, CASE WHEN review % 50 = 0 THEN NULL WHEN review % 3 = 0 THEN review * 1000003000017 % 998244353111111 ELSE review END AS ordinal FROM reviews)
        SELECT review, CASE WHEN ordinal IS NULL THEN -1 ELSE row_number() OVER (ORDER BY ordinal NULLS LAST) - 1 END AS position FROM o""",
    "empty_only_places": f"{W}, t AS (SELECT place || '-' || CAST(review // 100 AS VARCHAR) AS place, length(review_text) < 1500 AS blank FROM reviews) SELECT place FROM t GROUP BY place HAVING bool_and(blank)",
    "rating_rules": f"{W} SELECT review, CAST(CASE WHEN rating - review % 3 >= 4 THEN 0.9 WHEN rating - review % 3 >= 3 THEN 0.5 WHEN rating IS NOT NULL THEN 0.1 END AS DOUBLE) AS score FROM reviews",
    "label_rules": f"""{W}, l AS (SELECT review, (['POSITIVE', 'negative', 'LABEL_1', 'label_0', 'odd', '5 stars', '2 stars', '긍정', 'neutral'])[review % 9 + 1] AS label, (review % 10) / 10.0::DOUBLE AS s,
        lower(trim((['true', ' Yes ', '0', 'T', 'no', '1'])[review % 6 + 1])) IN ('true', '1', 'yes', 'y', 't') AS flag FROM reviews),
        m AS (SELECT review, flag, s, CASE WHEN label IN ('POSITIVE', 'LABEL_1', '긍정') THEN 'p' WHEN label IN ('negative', 'label_0') THEN 'n' ELSE 'u' END AS k, label FROM l),
        x AS (SELECT *, CASE WHEN s >= 0.6 THEN 'positive' WHEN s <= 0.4 THEN 'negative' ELSE 'neutral' END AS ul, CASE WHEN s >= 0.6 THEN s WHEN s <= 0.4 THEN 1 - s ELSE 0.5 END AS us FROM m)
        SELECT review, CASE k WHEN 'p' THEN 'positive' WHEN 'n' THEN 'negative' ELSE ul END AS label, round((CASE k WHEN 'p' THEN s WHEN 'n' THEN 1 - s ELSE us END) + 1e-10::DOUBLE, 6) + 0.0 AS score,
        CASE label WHEN 'LABEL_1' THEN 'negative' WHEN '5 stars' THEN 'positive' WHEN '2 stars' THEN 'negative' ELSE ul END AS star_label,
        round((CASE label WHEN 'LABEL_1' THEN 0.1 WHEN '5 stars' THEN 0.9 WHEN '2 stars' THEN 0.3 ELSE us END::DOUBLE) + 1e-10::DOUBLE, 6) + 0.0 AS star_score, flag FROM x""",
    "script_filter": rf"{W} SELECT review, regexp_replace(review_text, '[^A-Za-z\s]', '', 'g') AS latin, ' 한글 ' AS hangul FROM reviews",
    "search_query": f"{W} SELECT review, CASE WHEN review % 2 = 0 THEN place || ' ' || district ELSE place END AS query FROM reviews",
    "fingerprint": f"{W} SELECT review, sha1(coalesce(place, '') || chr(10) || coalesce(district, '') || chr(10) || coalesce(CAST(rating AS VARCHAR), '') || chr(10) || review_text || chr(10)) AS sha1 FROM reviews",
    "data_url": f"{W} SELECT review, 'data:image/jpeg;base64,' || base64(encode(review_text)) AS url FROM reviews",
    "district_parse": f"""{W} SELECT review, CASE WHEN review % 4 <> 0 THEN 'Cafe ' || place ELSE 'Cafe' END AS base, CASE WHEN review % 4 <> 0 THEN district END AS district,
        CASE WHEN review % 4 <> 0 AND review % 3 = 0 THEN 'old' END AS neighborhood FROM reviews""",
    "tiered_place_match": f"""{W}, k AS (SELECT 'src' || CAST(s_suppkey % 40 AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN ' east' ELSE '' END AS n, (['en', 'fr', 'de', 'es'])[s_suppkey % 4 + 1] AS kd, 'n' || CAST(s_suppkey % 2 AS VARCHAR) AS kn, s_suppkey AS o FROM supplier),
        p AS (SELECT review, place AS name, district, CASE WHEN review % 2 = 0 THEN 'n' || CAST((review // 2) % 2 AS VARCHAR) END AS hood FROM reviews),
        m AS (SELECT review, CASE WHEN n = name THEN 1 ELSE 2 END AS tier, o FROM p JOIN k ON kd = district AND (hood IS NULL OR hood = kn) AND starts_with(n, name)),
        f AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY tier, o) AS r FROM m)
        SELECT p.review AS place, CAST(f.tier AS DOUBLE) AS tier, CAST(f.o AS DOUBLE) AS match FROM p LEFT JOIN f ON p.review = f.review AND f.r = 1""",
    "district_lookup": f"""{W}, k0 AS (SELECT place || CASE WHEN place IN ('src3', 'src14') THEN ' x' ELSE '' END AS k, district, review AS o FROM reviews),
        k AS (SELECT k, arg_min(district, o) AS district, min(o) AS o FROM k0 GROUP BY k),
        n AS (SELECT DISTINCT place || CASE WHEN review % 2 = 0 THEN ' east' ELSE '' END AS place FROM reviews UNION SELECT 'nowhere at all'),
        w AS (SELECT place, string_split(place, ' ')[1] AS word FROM n),
        j AS (SELECT w.place, a.district AS d1, b.district AS d2, (SELECT arg_min(c.district, c.o) FROM k c WHERE contains(c.k, w.word)) AS d3
              FROM w LEFT JOIN k a ON a.k = w.place LEFT JOIN k b ON b.k = w.word)
        SELECT place, coalesce(d1, d2, d3) AS district, CAST(CASE WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 WHEN d3 IS NOT NULL THEN 3 END AS DOUBLE) AS tier FROM j""",
    # A word's grams of two to five characters, with a blank at either end; a bucket is the last twelve bits of a gram's MD5.
    "hash_encode": rf"""{W}, w AS (SELECT review, ' ' || unnest(list_filter(string_split_regex(lower(review_text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM reviews),
        n AS (SELECT review, w, CAST(unnest([2, 3, 4, 5]) AS INT) AS n FROM w), i AS (SELECT review, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM n WHERE n <= length(w)),
        g AS (SELECT review, count(DISTINCT substr(md5(substr(w, CAST(i AS INT), n)), 30, 3)) AS filled FROM i GROUP BY review)
        SELECT r.review, CAST(coalesce(filled, 0) AS INT) AS filled, CASE WHEN filled > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM reviews r LEFT JOIN g USING (review)""",
    "evidence_spans_exact": f"""{OWN_WORDS_SQL} SELECT review, CAST(strpos(t, e) - 1 AS INT) AS start, CAST(strpos(t, e) - 1 + length(e) AS INT) AS stop, 'exact' AS tier FROM own WHERE e <> '' AND contains(t, e)""",
    "evidence_spans_spaced": f"""{W}, w AS (SELECT review, review_text AS t, list_slice(list_filter(string_split_regex(review_text, '[ @n]+'), lambda x: x <> ''), 2, 5) AS ws FROM reviews),
        s AS (SELECT review, t, array_to_string(ws, '') AS e, regexp_replace(t, '[ @n]', '', 'g') AS solid, list_filter(range(length(t)), lambda i: substr(t, CAST(i AS INT) + 1, 1) NOT IN (' ', chr(10))) AS places FROM w WHERE len(ws) > 1)
        SELECT review, CAST(places[strpos(solid, e)] AS INT) AS start, CAST(places[strpos(solid, e) + length(e) - 1] + 1 AS INT) AS stop, 'spaced' AS tier FROM s WHERE contains(solid, e)""".replace("@n", chr(92) + "n"),
    "highlighted_text": f"""{OWN_WORDS_SQL} SELECT review, md5(CASE WHEN e = '' THEN {HTML_SQL.format("t")} ELSE {HTML_SQL.format("substr(t, 1, CAST(strpos(t, e) AS INT) - 1)")} || '<mark>' || {HTML_SQL.format("e")} || '</mark>'
        || {HTML_SQL.format("substr(t, CAST(strpos(t, e) AS INT) + CAST(length(e) AS INT))")} END) AS html FROM own WHERE contains(t, e)""",
    "row_slice": f"{W} SELECT review, place FROM reviews ORDER BY review LIMIT 50 OFFSET 40",
    "group_evaluation": rf"""{W}, s AS (SELECT *, {_strip("review_text")} AS t FROM reviews),
        n AS (SELECT *, len(list_filter(list_transform(string_split_regex(t, '[.!?]\s+'), lambda x: {_strip("x")}), lambda x: length(x) > 1)) AS k FROM s)
        SELECT place, district, CAST(count_if(t <> '') AS BIGINT) AS reviews, CAST(sum(CASE WHEN t = '' THEN 0 WHEN k = 0 THEN 1 ELSE k END) AS BIGINT) AS sentences, round((avg(rating)) + 1e-10::DOUBLE, 6) + 0.0 AS rating,
        round((avg({b.LEXICON_SQL.format("review_text")})) + 1e-10::DOUBLE, 6) + 0.0 AS sentiment, md5(string_agg(review_text, chr(10) ORDER BY review)) AS texts FROM n GROUP BY place, district""",
    "char_ngram_cosine": f"""{W}, t AS (SELECT review, lower(review_text) AS t FROM reviews),
        g AS (SELECT review, substr(t, CAST(i AS INT), 3) AS g, count(*) AS n FROM (SELECT review, t, unnest(range(1, length(t) - 1)) AS i FROM t WHERE length(t) >= 3) GROUP BY ALL),
        l AS (SELECT review, sqrt(sum(n * n)) AS len FROM g GROUP BY review), d AS (SELECT a.review, sum(a.n * c.n) AS dot FROM g a JOIN g c ON c.review = a.review + 1 AND a.g = c.g GROUP BY a.review)
        SELECT d.review, round((dot / (x.len * y.len)) + 1e-10::DOUBLE, 6) + 0.0 AS cosine FROM d JOIN l x ON x.review = d.review JOIN l y ON y.review = d.review + 1""",
}
