import numpy as np

from venuescope.llm import line_dedup as ld


def brute(docs):
    first, out = {}, {}
    keys = lambda t: [(line, line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})) for line in t.split("\n")]
    for i, t in sorted(docs):
        for _, k in keys(t):
            first.setdefault(k, i)
    for i, t in docs:
        out[i] = "\n".join(line for line, k in keys(t) if len(k) < 10 or first[k] == i)
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [f"Shared line number {i}" for i in range(40)] + ["short", "", "Éééééééééé", "éé"]
    docs = [(int(i), "\n".join(rng.choice(pool, 12)) + f"\nown line of document {i}") for i in rng.permutation(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for size in (64, 32 << 20):  # a filter too small for its repeats changes nothing but the shuffle
        got = {r.doc_id: r.text for r in ld.line_dedup(df, filter_bytes=size).collect()}
        assert got == brute(docs)


def test_odd_rows(odd, nothing):
    rows = {}
    for r in ld.line_dedup(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == 13
    assert [(r.n_lines, r.n_dropped, r.text) for r in rows[1] + rows[2]] == [(1, 0, "")] * 2
    assert rows[-5][0].n_dropped == 0  # the smallest id keeps the line
    assert [(r.n_lines, r.n_dropped, r.text) for r in rows[4]] == [(4, 2, "short\n")] * 2
    assert rows[5][0].n_dropped == 1 and rows[None][0].n_dropped == 1
    assert ld.line_dedup(nothing).count() == 0


def test_rows_keep_their_columns(odd, nothing):
    done = ld.dedup_rows(odd)
    assert done.columns == odd.columns and done.count() == 13
    assert done.where("doc_id = 1").first().text is None
    assert ld.dedup_rows(nothing).columns == odd.columns


def test_bloom_never_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    bloom = ld.Bloom(ld._sized(len(keys)))
    bloom.add(keys)
    assert bloom.has(keys).all() and bloom.has(rng.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.02
