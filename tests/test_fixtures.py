"""Hand-made cases whose results follow from the definitions."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from venuescope import constants as C
from venuescope.functions import format as ff
from venuescope.functions import geo, text, vectors
from venuescope.functions import sentiment as fs
from venuescope.operators import evidence, images, keywords, mapping, places, recommend, similarity, spans, stats


@pytest.fixture(scope="module")
def one(spark):
    def value(expr, **columns):
        df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in columns.items())) if columns else spark.range(1)
        return df.select(expr.alias("v")).first().v

    return value


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([("aesthetics", 0, "physical"), ("comfort", 1, "physical"), ("symbolism", 2, "meaning")], "factor string, factor_order int, category string")


@pytest.fixture(scope="module")
def scored(spark, dims):
    rows = [("A", "aesthetics", "positive", "0.9", "e1", 1), ("A", " aesthetics", "negative", "0.7", "e2", 2), ("A", "aesthetics", "positive", "0.8", "e1", 3), ("A", "comfort", "mixed", "0.5", "e3", 4), ("A", "comfort", "WEIRD", None, "e4", 5), ("A", "unknown-factor", "positive", "1", "e5", 6)]
    return evidence.scored(spark.createDataFrame(rows, "place string, factor string, hint string, confidence string, evidence string, ordinal int"), dims)


def test_evidence_scoring(scored, dims):
    by = {r.factor: r for r in evidence.factor_scores(scored).collect()}
    a, c = by["aesthetics"], by["comfort"]
    assert (a.mention_count, round(a.factor_score, 9), a.mention_share, round(a.avg_confidence, 9)) == (3, round(1 / 3, 9), 0.6, 0.8)
    assert (c.mention_count, c.factor_score, c.avg_confidence, c.neutral_count, c.mixed_count) == (2, 0, 0.5, 1, 1)
    p = evidence.place_scores(evidence.factor_scores(scored)).first()
    assert p.placeness_score == pytest.approx(0.2) and p.mean_factor_score == pytest.approx(1 / 6) and p.avg_confidence == pytest.approx(0.65)
    assert (p.positive_ratio, p.negative_ratio, p.most_mentioned) == (0.4, 0.2, "aesthetics")
    assert {r.factor: r.examples for r in evidence.examples(scored, ["factor"]).collect()}["aesthetics"] == "e1 | e2"
    done = {r.factor: r for r in evidence.completed(evidence.factor_scores(scored), dims).collect()}
    assert (done["symbolism"].mention_count, done["symbolism"].factor_score, done["symbolism"].category) == (0, None, "meaning")


def test_missing_columns_are_named(spark, dims):
    with pytest.raises(ValueError, match="hint"):
        evidence.scored(spark.range(1).selectExpr("'a' place", "'b' factor"), dims)


def test_similarity_scoring(spark):
    reviews = [("B", 1, "f1", 0, 0.8), ("B", 2, "f1", 0, 0.4), ("B", 1, "f2", 1, 0.2)]
    by_review = spark.createDataFrame(reviews, "place string, review int, factor string, factor_order int, review_score double")
    grid = spark.createDataFrame([(p, f"f{i + 1}", i) for p in "BC" for i in range(10)], "place string, factor string, factor_order int")
    weighted = similarity.weights(similarity.fsi(by_review, grid))
    got = {(r.place, r.factor): r for r in weighted.collect()}
    assert (got["B", "f1"].fsi, got["B", "f1"].n, got["B", "f3"].fsi, got["B", "f3"].n) == (pytest.approx(0.6), 2, 0.5, 0)
    assert got["B", "f1"].weight == pytest.approx(2 / 3)
    told = {r.place: r for r in similarity.deviants(weighted).collect()}
    assert told["B"].mu == pytest.approx(1.4 / 3) and told["B"].sigma == pytest.approx(math.sqrt(0.0096))
    assert (told["B"].strong, told["B"].weak) == ("f1", "f2")
    assert (told["C"].mu, told["C"].strong, told["C"].weak) == (0, "", "")
    wide = similarity.wide(weighted, ["f1", "f2"]).where("place = 'B'").first()
    assert wide.f1_n == 2 and wide.f2_fsi == pytest.approx(0.2)


def test_sentences(one):
    cut = lambda t: one(text.sentences(F.col("t")), t=t)
    assert cut("Good. Bad!  Ok") == ["Good", "Bad", "Ok"] and cut("x") == ["x"] and cut(" ") == [] and cut("Fine.") == ["Fine."]
    assert one(text.sentences_with_ends(F.col("t")), t="Good. Bad!") == ["Good.", "Bad!"]


def test_flags(one):
    assert [one(text.is_number(F.col("t")), t=t) for t in ("5", " 4.5 ", "5.", "-1", None)] == [True, True, False, False, False]
    assert [one(text.is_metadata(F.col("t")), t=t) for t in ("음식: 5", "음식: 5 좋아요", "식사 유형브런치", None)] == [True, False, True, False]
    assert one(text.language(F.col("t")), t="좋 ok") == "ko" and one(text.language(F.col("t")), t="ok") == "en"
    assert one(text.place_key(F.lit("A"), F.lit("강남구"), F.lit("역삼동"))) == "A 강남구 역삼동" and one(text.place_key(F.lit("A"), F.lit("강남구"), F.lit(None))) == "A"


def test_cleaning(one):
    assert one(text.cleaned(F.col("t")), t="지역 가이드 · 리뷰 1,370개 · 사진 34장 2년 전 참 좋다") == "참 좋다"
    assert one(text.cleaned(F.col("t"), F.col("a")), t="Kim.리뷰 2개 좋다 kim.3주 전", a="Kim.") == "좋다 kim."
    assert one(text.scraped(F.col("t")), t="3달 전 HJ리뷰 2개 · 사진 3장 좋다 더보기") == "좋다"
    parts = one(text.place_parts(F.col("t"), F.array(*map(F.lit, C.DISTRICTS))), t="스타 벅스 강남구 역삼동")
    assert (parts.base, parts.district, parts.neighborhood) == ("스타 벅스", "강남구", "역삼동")


def test_ratings_and_labels(one):
    assert [one(fs.rating_score(F.col("r")), r=r) for r in (4.0, 3.0, 2.9)] == [0.9, 0.5, 0.1]
    score = lambda label, s, stars=False: one(fs.normalised(F.col("l"), F.col("s"), stars)["score"], l=label, s=s)
    assert score("POSITIVE", 0.8) == 0.8 and score("NEGATIVE", 0.8) == pytest.approx(0.2) and score("NEUTRAL", 0.55) == 0.5 and score("4 stars", 0.3, True) == 0.7


def test_lexicon(one):
    of = lambda t: one(fs.lexicon_score(F.col("t")), t=t)
    assert of("참 만족") == pytest.approx(0.62) and of("별로") == pytest.approx(0.38) and of("-") == 0.5 and of("만족 추천 깔끔 예쁘 편안") == 0.95


def test_boosts(one):
    assert one(text.walking_score(F.col("t")), t="도보로 7분") == 0.9 and one(text.walking_score(F.col("t")), t="도보 3분, 20분 거리") == 0.95
    assert one(text.walking_score(F.col("t")), t="멀다") is None
    assert one(vectors.keyword_boost(F.col("k")), k=1) == pytest.approx(0.8) and one(vectors.keyword_boost(F.col("k")), k=6) == 0.95 and one(vectors.keyword_boost(F.col("k")), k=0) is None
    assert one(vectors.boosted(F.lit(1.0), F.lit(2), F.lit(0.8), F.lit(None).cast("double"))) == pytest.approx(3.4 / 5)


def test_geo(one):
    assert one(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(111_194.93, abs=0.01)


def test_legacy_names(spark):
    rows = [("A", "사회성", 0.6, 2, 0.7), ("A", "참여성", None, None, 0.6), ("A", "형태성", 0.3, 1, 0.1)]
    got = {r.factor: r for r in similarity.current_factors(spark.createDataFrame(rows, "place string, factor string, fsi double, n int, weight double")).collect()}
    merged = got["상호작용성"]
    assert (merged.fsi, merged.n, merged.weight) == (0.6, 2, 1.0) and got["개방성"].fsi == 0.3


def test_recommendation_defaults(spark):
    rows = spark.createDataFrame([("A", "f1", 0.8, None), ("A", "f2", None, None)], "place string, factor string, fsi double, fsi_raw double")
    assert recommend.by_mean(rows, ["f1", "f2"]).first().score == pytest.approx(0.65)
    assert recommend.by_told_mean(rows, ["f1", "f2"]).first().score == 0.8


def test_readiness(spark):
    shots = ["좌석 영역", "외관", "디테일/소품"] + ["미분류"] * 5
    df = spark.createDataFrame([("A", s, 1.5, True) for s in shots], "place string, shot_type string, megapixels double, in_sequence boolean")
    r = images.readiness(df).first()
    assert (r.score, r.label, r.images, r.shot_types) == (85, "high", 8, 3)


def test_pixels():
    import numpy as np

    grey = np.full((10, 20, 3), 100, np.uint8)
    assert images.pixel_stats(grey) == (100.0, 0.0, 0.0, 200 / 1e6) and images.pixel_stats(grey[:, :, 0]) is None


def test_duplicates_and_samples(spark):
    rows = spark.createDataFrame([("p", "kim", "x" * 150 + t, i) for i, t in enumerate("aab")] + [("p", "lee", "x" * 150, 3)], "place string, author string, t string, ordinal int")
    kept = places.first_of_copies(rows, [F.col("place"), F.col("author"), F.substring("t", 1, 150)], "ordinal")
    assert sorted(r.ordinal for r in kept.collect()) == [0, 3]
    strata = spark.range(50).selectExpr("id", "if(id < 7, 'a', 'b') s")
    sizes = {r.s: r["count"] for r in places.stratified(strata, "s", "id", 10).groupBy("s").count().collect()}
    assert sizes == {"a": 7, "b": 10}
    assert [r.review_index for r in places.numbered(spark.createDataFrame([(9000,), (3,), (-5,), (70000,)], "o long"), "o").orderBy("o").collect()] == [0, 1, 2, 3]


def test_correlation_needs_eleven(spark):
    of = lambda n: stats.correlations(spark.range(n).selectExpr("id * 1.0d a", "id * 2.0d + id % 2 b"), ["a", "b"]).first().r
    assert of(10) is None and of(11) == pytest.approx(0.9975, abs=0.01)


def test_spans():
    review = "The room was bright and the coffee smelled wonderful all day long."
    assert spans.find(review, ["bright and"]) == [(13, 23, "exact")]
    assert spans.find(review, ["brightand the"])[0][2] == "spaced"
    near = spans.find(review, ["coffee smelt wonderful all day"])[0]
    assert near[2] == "near" and review[near[0] : near[1]].startswith("coffee")
    assert spans.find(review, ["nothing like it whatsoever"]) == [] and spans.joined([(5, 9), (0, 5), (12, 13)]) == [(0, 9), (12, 13)]
    assert spans.marked("a < b", ["b"]) == "a &lt; <mark>b</mark>"


def test_mapping(spark):
    line = '{"reviews":[{"review_index":1,"items":[{"sentence_id":0,"mappings":[{"factor":" f ","confidence":"7","evidence":" e ","sentiment_hint":"Odd"},{"factor":"g"}]},{"sentence_id":9,"mappings":[{"factor":"f"}]}]}]}'
    lines = spark.createDataFrame([(line,), ("{broken",), ("",)], "value string")
    reviews = spark.createDataFrame([(1, "One. Two three."), (2, "Four.")], "review_index long, review_text string")
    flat = mapping.flattened(lines, mapping.review_sentences(reviews), ["f"])
    (r,) = flat.collect()
    assert (r.factor, r.confidence, r.evidence, r.sentiment_hint, r.sentence) == ("f", 1.0, "e", "neutral", "One.")
    wide = {r.review_index: r for r in mapping.pivoted(flat, reviews.select("review_index"), ["f"]).collect()}
    assert (wide[1].f_mapped, wide[1].f_sentence_count, wide[2].f_mapped, wide[2].f_max_confidence, wide[2].f_evidence) == (True, 1, False, 0.0, "")
    asked = mapping.labelled(reviews, lambda texts: [t.upper() for t in texts]).orderBy("review_index").collect()
    assert asked[1].answer == "FOUR."


def test_image_answers(spark):
    df = spark.sql("select 'A' place, map('x', named_struct('score', '1.7', 'confidence', 'high', 'insufficient', 'false')) factors")
    got = {r.factor: r for r in mapping.image_answer(df, ["x", "y"]).collect()}
    assert (got["x"].image_score, got["x"].confidence, got["x"].insufficient) == (1.0, 0.3, False)
    assert (got["y"].image_score, got["y"].insufficient) == (0.5, True)


def test_model_hook(spark):
    score = fs.model_udf(lambda: lambda texts: [len(t) / 10 for t in texts])
    assert [r.v for r in spark.createDataFrame([("abc",), (None,)], "t string").select(score("t").alias("v")).collect()] == [0.3, 0.0]


def test_formats(one):
    assert one(ff.score(F.lit(0.1234567))) == "0.123" and one(ff.score(F.lit(None).cast("double"))) == "-"
    assert [one(ff.signed(F.lit(v))) for v in (0.25, -0.25, -0.0001)] == ["+0.250", "-0.250", "0.000"]
    assert one(ff.percent(F.lit(0.125))) == "12.5%" and one(ff.count(F.lit(1234567), "개")) == "1,234,567개"
    assert one(similarity.summary(F.lit(0.5), F.lit(0.1), F.lit("a"), F.lit(""))) == "[0.500 ± 0.100, +a, -]"


def test_chart_rows(spark):
    df = spark.createDataFrame([("A", "f1", 0, 0.1), ("A", "f2", 1, 0.2)], "place string, factor string, factor_order int, fsi double")
    assert [(r.factor, r.point) for r in ff.radar(df).orderBy("point").collect()] == [("f1", 1), ("f2", 2), ("f1", 3)]
    points = spark.createDataFrame([(1.0, 2.0, 3), (1.0, None, 3)], "lat double, lng double, v int")
    assert [r.row for r in ff.heat(points, "v").collect()] == [[1.0, 2.0, 3.0]]
    wide = spark.createDataFrame([(1, 2, 3)], "place int, s_a int, s_a_calc int")
    assert ff.by_suffix(wide, "_calc").columns == ["place", "s_a"] and ff.by_prefix(wide, "s_", "place").columns == wide.columns


def test_names_and_blanks(spark):
    df = spark.createDataFrame([("a", " "), (None, "x"), ("b", "y")], "name string, t string")
    own = places.with_defaults(df, {"name": "place", "t": "review_text", "zzz": "other"})
    assert own.columns == ["name", "t", "place", "review_text"] and [r.place for r in places.known_reviews(own).collect()] == ["b"]
    assert [r.name for r in places.only_blank(df.dropna(), "name", "t").collect()] == ["a"]


def test_image_rows(spark):
    pixels = bytearray([100, 100, 100] * 200)
    df = spark.createDataFrame([("a", pixels, 10, 20, 3), ("b", bytearray(200), 10, 20, 1)], "path string, pixels binary, height int, width int, channels int")
    got = {r.path: r for r in images.image_stats(df).collect()}
    assert (got["a"].brightness, got["a"].contrast, got["a"].megapixels) == (100.0, 0.0, 200 / 1e6) and got["b"].brightness is None


def test_labelling_is_asked_again(spark):
    waits, calls = [], []

    def service(texts):
        calls.append(list(texts))
        if texts == ["bad"] or len(calls) < 3:
            raise TimeoutError
        return [t.upper() for t in texts]

    assert mapping.asked(service, ["a", "b"], 5, 1.0, 60.0, waits.append) == ["A", "B"] and waits == [1.0, 2.0]
    waits.clear()
    assert mapping.asked(service, ["bad"], 8, 1.0, 60.0, waits.append) == [None] and waits == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0]
    assert mapping.asked(lambda t: [], ["a"], 1, 1.0, 60.0, waits.append) == [None]


def test_p_values():
    # Two-sided points of Student's t from printed tables.
    for t, n, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 100_000, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01), (0.7, 10, 0.4998)):
        assert abs(stats.t_tail(t, n) - p) < 2e-4


def test_first_model_that_loads():
    def missing():
        raise ImportError

    assert vectors.first_that_loads([missing, lambda: len])("abc") == 3
    assert abs(sum(vectors.first_that_loads([missing])(["some text"])[0] ** 2) - 1) < 1e-9


def test_names_with_pattern_marks(spark):
    df = spark.createDataFrame([("a\\E.b 좋다 a\\E.b 3년 전", "a\\E.b")], "t string, a string")
    assert df.select(text.cleaned(F.col("t"), F.col("a"))).first()[0] == "좋다 a\\E.b"


def test_numbers_of_sparse_ordinals(spark):
    import random

    rng = random.Random(1)
    ids = list({rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)})
    rows = places.numbered(spark.createDataFrame([(i,) for i in ids], "o long"), "o", ranges=16).collect()
    assert {r.o: r.review_index for r in rows} == {i: n for n, i in enumerate(sorted(ids))}
    assert places.numbered(spark.createDataFrame([], "o long"), "o").count() == 0


def test_quantiles_of_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", 0.5)] * 300 + [("b", 0.9)] * 20 + [("c", 2.0), ("d", None)]
    got = {r.g: r.cut for r in similarity.group_quantile(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.9, 8).collect()}
    assert set(got) == {"a", "b", "c"}
    assert all(abs(got[g] - np.quantile([v for k, v in rows if k == g], 0.9)) < 1e-9 for g in got)


def test_vectors_come_in_small_batches():
    """A batch of vectors is bounded whatever the number of texts in the batch read; each text keeps its own."""
    texts = [f"word{n} and more" for n in range(1000)]
    parts = list(vectors.hash_encoded.func(iter([pd.Series(texts)])))
    assert max(map(len, parts)) <= 256
    own = [v for p in parts for v in p]
    assert len(own) == 1000 and all((own[n] == vectors.hash_vector(texts[n]).astype("float32")).all() for n in (0, 500, 999))


def test_an_ngram_is_hashed_once(monkeypatch):
    """New words of known n-grams cost no hashing; 4,096 words of four letters have 2,040 n-grams, 22 a word."""
    calls, md5 = [], vectors.hashlib.md5
    monkeypatch.setattr(vectors.hashlib, "md5", lambda gram: calls.append(gram) or md5(gram))
    words = ["".join(w) for w in itertools.product("აბგდ", repeat=6)]
    list(vectors.hash_encoded.func(iter([pd.Series([" ".join(words[n::64]) for n in range(64)])])))
    assert len(calls) == 2040


def test_vectors_of_many_texts_are_those_of_each(monkeypatch, spark):
    """Whatever is looked up at a time, and however few n-grams a worker remembers."""
    rng = random.Random(1)
    texts = ["", " ", "a", "a b", "\0", "\0\0 \0\0\0", "İstanbul ΣΑΣ ß", "가나다라 마바사 \U0001f600\U0001f600a\U0010ffff", "x" * 50, *("".join(rng.choices("ab 가\0\U0010ffff", k=n)) for n in range(40))]
    want = [vectors.hash_vector(t).astype("float32") for t in texts]
    # Worked out by hand: each gram of " ab " once.
    own = sorted(int(hashlib.md5(g.encode()).hexdigest()[-3:], 16) for g in (" a", "ab", "b ", " ab", "ab ", " ab "))
    assert vectors.hash_matrix(["ab"])[0].nonzero()[0].tolist() == own
    for chunk, bits in ((1, 1), (3, 20), (7, 3), (1 << 16, 20)):
        monkeypatch.setattr(vectors, "LOOKED_UP", chunk)
        monkeypatch.setattr(vectors, "SLOT_BITS", bits)
        vectors._remembered.cache_clear()
        for found in (vectors.hash_matrix(texts), vectors.hash_matrix(texts), [vectors.hash_matrix([t])[0] for t in texts]):
            assert all((a == b).all() for a, b in zip(found, want, strict=True))
    vectors._remembered.cache_clear()
    assert all((a == vectors.hash_vector(t)).all() for a, t in zip(vectors.first_that_loads([])(texts), texts, strict=True))
    parts = list(vectors.hash_encoded_arrow.func(iter([pa.array(texts * 10), pa.array([], pa.string()), pa.array(texts)])))
    assert max(map(len, parts)) <= 256
    assert all(a == b.tolist() for a, b in zip((v for p in parts for v in p.to_pylist()), want * 11, strict=True))
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string").repartition(3)
    got = {r.k: r.v for r in df.select("k", vectors.hash_encoded_arrow("t").alias("v")).collect()}
    assert got == {-1: [0.0] * 4096, **{k: v.tolist() for k, v in enumerate(want)}}


def test_next_cosine_without_a_table_of_grams(spark):
    """Keys that repeat, have gaps, are below 0 or lie over the end of a block; and no row is made for a gram."""
    texts = {k: f"text {abs(k) % 7} and {'more ' * (abs(k) % 3)}\U0001f600" for k in [*range(-70, 70), 1000, (1 << 60) - 1, 1 << 60]} | {5: "ab", 200: "aaaa", 201: "bbbb"}
    rows = [*texts.items(), (7, "again more"), (None, "text 1"), (8, None)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    counts: dict = {}
    for k, t in rows:
        for i in range(len(t or "") - 2):
            own = counts.setdefault(k, {})
            own[t[i : i + 3]] = own.get(t[i : i + 3], 0) + 1
    want = {}
    for k, a in counts.items():
        b = counts.get(k + 1, {}) if k is not None else {}
        if dot := sum(n * b.get(g, 0) for g, n in a.items()):
            want[k] = dot / math.sqrt(sum(n * n for n in a.values())) / math.sqrt(sum(n * n for n in b.values()))
    found = similarity.next_cosine(df, "k", "t")
    got = {r.k: r.cosine for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert (1 << 60) - 1 in got and -1 in got and 63 in got and found._jdf.queryExecution().toString().count("Join") == 0


def test_frequent_words_with_few_held(spark, monkeypatch):
    """Words dropped on the way, of which a task holds no more than twice what it sends, do not change the outcome."""
    monkeypatch.setattr(keywords, "SENT", 8)
    monkeypatch.setattr(keywords, "HELD", 20)
    monkeypatch.setattr(keywords, "TAKEN", 2)
    rows = [("a" if n % 2 else "b", " ".join(f"w{n * 31 % 97} w{m}" for m in range(6 + n % 5))) for n in range(300)] + [("c", None)]
    df = spark.createDataFrame(rows, "place string, t string").coalesce(2)
    counts = Counter(w for _, t in rows for w in (t or "").split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[:12]
    got = keywords.tfidf(df, "place", "t", [], 12).collect()
    assert {r.word for r in got} == set(top)
    assert {(r.place, r.word): r.tf for r in got} == Counter((g, w) for g, t in rows for w in (t or "").split() if w in top)
