import random

from pyspark.sql import functions as F

from venuescope.llm import exact_dedup as ed


def test_index_holds_what_is_live():
    rng = random.Random(1)
    index, live = ed.CuckooIndex(buckets=4), {}
    for n in range(20_000):
        d = rng.randbytes(32)
        if rng.random() < 0.3 and live:
            gone = rng.choice(list(live)[-50:])
            assert index.delete(gone) and not index.delete(gone)
            del live[gone]
        index.insert(d, n)
        live[d] = n
    assert index.resizes > 3 and index.size == len(live)
    assert all(index.get(d)[1] == n for d, n in live.items())
    assert index.get(rng.randbytes(32)) is None and {e[0]: e[1] for e in index.entries()} == live


def test_equal_tags_are_told_apart_by_content():
    index = ed.CuckooIndex(buckets=4)
    same = bytes(range(24))
    for i in range(30):  # one tag and one pair of buckets for all: only the stored keys differ
        if i < 8:
            index.insert(same + bytes([i]) * 8, i)
    assert [index.get(same + bytes([i]) * 8)[1] for i in range(8)] == list(range(8))
    assert index.get(same + bytes([99]) * 8) is None


def test_odd_rows(odd, nothing):
    rows = ed.exact_dedup(odd).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {(r.keep_id, r.group_size, r.kept) for r in by[1] + by[2]} == {(1, 2, True), (1, 2, False)}
    assert by[3][0].kept and by[10_000_000_000][0].keep_id == 3
    assert sorted((r.keep_id, r.group_size, r.kept) for r in by[4]) == [(4, 2, False), (4, 2, True)]
    assert by[None][0].keep_id is None and by[None][0].kept
    assert ed.exact_dedup(nothing).count() == 0


def test_longest_original_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "ab\n\n"), (4, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in ed.exact_dedup(docs).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4}


def test_one_of_several_rows_without_id_stays(spark):
    rows = [(None, "a b"), (None, "ab"), (None, "a b"), (None, "c"), (7, "d"), (7, "d"), (7, "e"), (None, "d ")]
    got = [tuple(r) for r in ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("digest", "doc_id", "keep_id", "group_size", "kept").collect()]
    assert len(got) == 8
    groups = {}
    for digest, doc, keep, n, kept in got:
        groups.setdefault(digest, []).append((doc, keep, n, kept))
    assert all(sum(k for *_, k in g) == 1 and {n for _, _, n, _ in g} == {len(g)} for g in groups.values())
    assert sorted(len(g) for g in groups.values()) == [1, 1, 3, 3]
    # The longest original of "d" has no id.
    assert all(keep is None for g in groups.values() if len(g) == 3 for _, keep, _, _ in g)


def test_updates_equal_a_rebuild(spark, tmp_path):
    def digests(rows, first):
        return ed.content_digests(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("row", F.col("key") * 10 + first)

    rng = random.Random(3)
    old = [(i, " " * rng.randrange(4) + f"text {rng.randrange(150)}") for i in range(600)]
    new = [(1000 + i, " " * rng.randrange(6) + f"text {rng.randrange(200)}") for i in range(200)]
    stored, inserts = digests(old, 1), digests(new, 2)
    gone = [i for i, t in old if rng.random() < 0.5 or t.endswith("7")]
    away = F.col("key").isin(gone)
    index = ed.build_index(stored, 64)
    deletes = stored.where(away).select("row", "digest").union(stored.limit(5).select("row", "digest")).union(inserts.select("row", "digest"))
    kept = {r.row for r in stored.limit(5).collect()}
    rebuilt = ed.build_index(stored.where(~away & ~F.col("row").isin(kept)).union(inserts), 64)
    after = ed.update_index(index, stored, inserts, deletes, 64)
    told = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert told(after) == told(rebuilt) and after.count() > 100
