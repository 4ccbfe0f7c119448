"""MaxScore against scores of all documents."""

import math
import random
import re

from pyspark.sql import functions as F

from venuescope.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=10):
    own = [(k, terms(t)) for k, t in docs]
    own = [(k, t) for k, t in own if t]
    total, length = len(own), sum(len(t) for _, t in own)
    out = []
    for item, text in items if own else ():
        if not terms(text):
            continue
        score = []
        for q in set(terms(text)):
            df = sum(q in t for _, t in own)
            w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
            score.append([w * (1_000_000_000 * t.count(q) // (1000 * t.count(q) + 8 * (10 + 90 * len(t) * total // length))) for _, t in own])
        sums = [(-sum(s), (k is None, k or 0), k) for s, (k, _) in zip(zip(*score, strict=True), own, strict=True)]
        for rank, (s, _, k) in enumerate(sorted(x for x in sums if x[0])[:most], 1):
            out.append((item, rank, k, -s))
    return sorted(out, key=repr)


def found(spark, docs, items, **settings):
    d = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.search(d, i, **settings).collect()), key=repr)


def test_against_all_scores(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda: f"W{int(draw.paretovariate(0.7)) % 400}"
    docs = [(n * 7 % 1000, " ".join(word() for _ in range(draw.randrange(60)))) for n in range(1000)]
    docs += docs[:50] + [(None, docs[3][1]), (5000, None)]
    items = [(n, " ".join(word() for _ in range(draw.randrange(1, 12)))) for n in range(30)] + [(40, ""), (41, None), (42, "never w1w1w1")]
    want = brute(docs, items)
    monkeypatch.setattr(search, "SHARD", 16)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_bytes=400) == want


def test_only_qualifying_documents_are_probed():
    import numpy as np

    rng = np.random.default_rng(1)
    n, weights = 2000, np.array([9000, 4000, 30, 20])
    rows = [np.flatnonzero(rng.random(4) < (0.01, 0.05, 0.9, 0.9)) for _ in range(n)]
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    shard = search.Shard(np.arange(n), np.full(n, 10), sizes, flat, np.ones(len(flat), np.int64), weights, n, 10 * n)
    whole = shard.best(np.arange(4), 0)
    cut = np.sort(whole[1])[-10]
    doc, score = shard.best(np.arange(4), int(cut))
    at = whole[1] >= cut
    assert doc.tolist() == whole[0][at].tolist() and score.tolist() == whole[1][at].tolist()


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "same LINE of text"), (1, "one"), (None, "a b"), (2, "été中文")]
    got = found(spark, odd, items)
    assert [x[:1] + x[2:] for x in got] == [x[:1] + x[2:] for x in brute(docs, items)]
    assert found(spark, nothing, items) == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert search.search(odd, empty).count() == 0


def test_clashing_names(spark, odd):
    named = odd.select(*(F.col(c).alias(n) for c, n in zip(odd.columns, ["doc_id", "text", "key", "score", "rank", "query", "n", "terms", "tfs", "item_id", "count"], strict=True)))
    assert found(spark, named, [(1, "same line")]) == found(spark, odd, [(1, "same line")])
