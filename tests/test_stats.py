"""Exact quantiles and keyword profiles against plain computations, with the limits of their methods drawn tight."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from venuescope.operators import keywords, stats

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns():
    draw = random.Random(2)
    n = 4000
    heavy = [1.0] * 1500 + [2.0] * 1500 + [draw.random() + 1 for _ in range(998)] + [None, float("nan")]
    far = [draw.choice([-1e300, 1e300, 0.0, math.inf, -math.inf]) for _ in range(n)]
    return list(zip(range(n), [draw.gauss(0, 1) for _ in range(n)], heavy, far, [None] * n, [5.0] * n, strict=True))


@pytest.mark.parametrize("ordered", [1, 7, 300, 1 << 16])
def test_quantiles_are_exact(spark, monkeypatch, ordered):
    monkeypatch.setattr(stats, "ORDERED", ordered)
    monkeypatch.setattr(stats, "SKETCH", 64)
    monkeypatch.setattr(stats, "ERROR", 0.02)
    rows = columns()
    names = ["whole", "normal", "heavy", "far", "none", "same"]
    df = spark.createDataFrame(rows, "whole long, normal double, heavy double, far double, none double, same double").repartition(3)
    got = {(r.metric, r.share): r.value for r in stats.quantiles(df, names, SHARES).collect()}
    want = {}
    for i, name in enumerate(names):
        own = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        for p in SHARES if own else ():
            at = p * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want[name, p] = a if at == math.floor(at) else a + (b - a) * (at - math.floor(at))
    same = lambda x, y: x == y or (x != x and y != y)
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)


def test_no_task_holds_a_column(spark):
    df = spark.range(100).selectExpr("cast(id as double) v")
    plan = stats.quantiles(df, ["v"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan


def test_describe_of_nothing(spark):
    df = spark.createDataFrame([], "v double, w double")
    assert [(r.metric, r["count"], r.q50) for r in stats.described(df, ["v", "w"]).collect()] == [("v", 0, None), ("w", 0, None)]
    assert stats.quantiles(df, ["v"], [0.5]).count() == 0


def words_of(text):
    return keywords.TOKEN.findall(text.lower())


@pytest.mark.parametrize(("sent", "survivors", "held"), [(200_000, 500_000, 1_000_000), (12, 500_000, 20), (5, 3, 1)])
def test_profiles_whatever_is_sent(spark, monkeypatch, sent, survivors, held):
    for name, value in (("SENT", sent), ("SURVIVORS", survivors), ("HELD", held)):
        monkeypatch.setattr(keywords, name, value)
    draw = random.Random(5)
    texts = [(draw.choice(["a", "b", "c", None]), " ".join(draw.choice(["Ab", "cd", "the", "x"]) + str(int(draw.paretovariate(0.6)) % 60) for _ in range(draw.randrange(30)))) for _ in range(200)]
    texts += [("a", None), ("e", ""), (None, None)]
    rows = spark.createDataFrame(texts, "g string, t string").repartition(4)
    stop, features = ["cd1"], 15
    totals = Counter(w for _, t in texts for w in words_of(t or "") if w not in stop)
    chosen = {w for w, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:features]}
    by = {g: Counter(w for h, t in texts if h == g for w in words_of(t or "") if w in chosen) for g in {g for g, _ in texts}}
    got = {(r.g, r.word): (r.tf, r.df) for r in keywords.tfidf(rows, "g", "t", stop, features).collect()}
    assert got == {(g, w): (n, sum(w in c for c in by.values())) for g, c in by.items() for w, n in c.items()}
    for g in by:
        length = math.sqrt(sum(r.tfidf**2 for r in keywords.tfidf(rows, "g", "t", stop, features).where(f"g <=> {'null' if g is None else repr(g)}").collect()))
        assert not by[g] or np.isclose(length, 1.0)
        break
    plain = {g: Counter(w for h, t in texts if h == g for w in (t or "").split()) for g in by}
    for r in keywords.hybrid(rows, "g", "t", stop, features, 5).where("g is not null").collect():
        share = plain[r.g][r.word] / sum(plain[r.g].values())
        assert np.isclose(r.share, share) and np.isclose(r.hybrid, r.tfidf * (1 + 2 * share)) and r["rank"] <= 5


@pytest.mark.parametrize(("block", "tile"), [(1 << 26, 1024), (2000, 7)])
def test_products_of_blocks(spark, monkeypatch, block, tile):
    from venuescope.operators import similarity

    monkeypatch.setattr(similarity, "TILE", tile)
    rng = np.random.default_rng(3)
    vector = lambda n: rng.normal(size=n).astype(np.float32).tolist()
    rows = [(n % 3, n, n, 0.5, vector(8)) for n in range(60)] + [(0, 60, 60, 0.5, [0.0] * 8), (0, 61, 61, None, None), (0, 62, 62, 0.5, vector(4))]
    anchors = [(f"f{n}", n, vector(8)) for n in range(40)] + [("short", 40, vector(4)), ("zero", 41, [0.0] * 8), ("none", 42, None)]
    a = spark.createDataFrame(rows, "place int, review long, sentence long, sentiment double, embedding array<float>")
    f = spark.createDataFrame(anchors, "factor string, factor_order int, embedding array<float>")

    def cosine(x, y):
        if x is None or y is None or len(x) != len(y) or not any(x) or not any(y):
            return None
        x, y = np.array(x), np.array(y)
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    want = {(r[2], g): cosine(r[4], v) for r in rows for g, _, v in anchors}
    got = {(r.sentence, r.factor): r.similarity for r in similarity.similarities(a, f, block_bytes=block).collect()}
    assert got.keys() == want.keys() and all((want[k] is None) == (got[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-6) for k in want)
    few = {(r.sentence, r.factor) for r in similarity.similarities(a, f, 0.4, block).collect()}
    assert few == {k for k, v in want.items() if v is not None and v >= 0.4}


def test_many_anchors(spark):
    from venuescope.operators import similarity

    rng = np.random.default_rng(4)
    many = rng.normal(size=(100_000, 16)).astype(np.float32)
    f = spark.range(100_000).select(F.concat(F.lit("f"), "id").alias("factor"), F.col("id").cast("int").alias("factor_order"), F.array(*(F.sin((F.col("id") + 1) * (k + 1.3)).cast("float") for k in range(16))).alias("embedding"))
    a = spark.createDataFrame([(0, n, n, 0.5, many[n].tolist()) for n in range(20)], "place int, review long, sentence long, sentiment double, embedding array<float>")
    table = np.stack([np.sin((np.arange(100_000) + 1.0) * (k + 1.3)).astype(np.float32) for k in range(16)], axis=1).astype(float)
    own = many[:20].astype(float)
    told = own @ table.T / np.linalg.norm(own, axis=1)[:, None] / np.linalg.norm(table, axis=1)
    got = {(r.sentence, r.factor_order) for r in similarity.similarities(a, f, 0.8, 4 << 20).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(told >= 0.8)), strict=True))
