"""Suffix-array decontamination against a comparison of all windows."""

import random
import re

from pyspark.sql import functions as F

from venuescope.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        n = min(window, len(w))
        parts = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ()
        for i in range(len(own) - n + 1 if parts else 0):
            if tuple(own[i : i + n]) in parts:
                hit.update(range(i, i + n))
                found.add(item)
    return len(own), sorted(hit), sorted(str(x) for x in found if x is not None)


def scanned(spark, docs, items, **settings):
    d = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.scan(d, i, **settings).collect()
    return sorted(((r.doc_id, r.n_words, [x for s in r.spans for x in range(s.start, s.stop)], list(r["items"])) for r in rows), key=repr)


def corpus(seed=4):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("ab cd é 中 F2 x9 zz".split()) + draw.choice(" .,-") for _ in range(n))
    items = [(n, text(draw.randrange(4, 60))) for n in range(25)]
    items += [(30, "one"), (31, "Two words"), (32, None), (33, "..."), (3, items[4][1]), (None, text(30)), (40, items[0][1])]
    docs = [(n, text(draw.randrange(80))) for n in range(60)]
    for n in range(60, 120):
        held = words(draw.choice(items)[1])
        at = draw.randrange(len(held) + 1)
        docs.append((n, text(draw.randrange(20)) + " ".join(held[at : at + draw.randrange(40)]) + "!\n" + text(draw.randrange(20))))
    docs += [(200, "one"), (201, "TWO\nwords one"), (202, None), (203, ""), (None, docs[70][1]), (70, docs[70][1]), (204, (items[0][1] + " y ") * 2000)]
    return docs, items


def test_against_all_windows(spark):
    docs, items = corpus()
    want = sorted(((k, *brute(t, items)) for k, t in docs), key=repr)
    assert sum(bool(w[2]) for w in want) > 20
    assert scanned(spark, docs, items) == want
    assert scanned(spark, docs, items, block_bytes=1000) == want
    assert decontaminate.Suffixes(items).searched()


def test_small_shards_give_the_same():
    docs, items = corpus(5)
    suffixes = decontaminate.Suffixes(items)
    one = decontaminate._shard([t.encode() if t else None for _, t in docs], suffixes, suffixes.searched(), {})
    each = [decontaminate._shard([t.encode() if t else None], suffixes, suffixes.searched(), {}) for _, t in docs]
    assert one[0] == [x for e in each for x in e[0]] and one[1] == [x for e in each for x in e[1]] and one[2] == [x for e in each for x in e[2]]


def test_longest_matches(spark):
    items = [(1, " ".join(f"w{i}" for i in range(30))), (2, "short one here")]
    docs = [(1, "x w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 y short one here"), (2, "w0 w1 w2"), (3, items[0][1] + " " + items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(d, i).collect())
    assert got == [(1, 1, "1", 3, 12), (1, 14, "2", 0, 3), (3, 0, "1", 0, 30), (3, 30, "1", 0, 30)]


def test_affected_documents_go(spark, odd):
    items = spark.createDataFrame([(1, "same line of text here"), (2, "words follow, TWICE as many as before")], "item_id long, text string")
    for block in (1 << 20, 10):
        kept = decontaminate.drop_contaminated(odd, items, block_bytes=block)
        assert kept.schema == odd.schema
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in odd.collect() if "same line of text here" not in (r.text or "").lower())


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    items = [(1, "same line of text here"), (9, "a")]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert scanned(spark, odd, items) == sorted(((k, *brute(t, items)) for k, t in docs), key=repr)
    named = odd.select(*(F.col(c).alias(n) for c, n in zip(odd.columns, ["doc_id", "text", "told", "items", "spans", "n_words", "text_", "k", "l", "m", "n"], strict=True)))
    assert scanned(spark, named, items) == scanned(spark, odd, items)
    assert decontaminate.drop_contaminated(named, spark.createDataFrame(items, "item_id long, text string")).columns == named.columns
    assert scanned(spark, nothing, items) == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in decontaminate.scan(odd, empty).collect()) and decontaminate.drop_contaminated(odd, empty).count() == odd.count()
    assert decontaminate.matches(odd, empty).count() == 0
