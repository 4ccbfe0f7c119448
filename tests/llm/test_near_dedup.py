import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from venuescope.llm import near_dedup


def roots(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both / len(sets[i] | sets[j]) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def shingled(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def planted():
    """Texts with copies at many distances, and one group that is larger than a small bucket."""
    rng = np.random.default_rng(3)
    texts = []
    for group in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [edited(rng, words, n) for n in (0, *(rng.integers(1, 8, 60 if group == 0 else 3)))]
    return texts


def test_stage_against_brute_force(spark, sf):
    texts = planted()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(set(roots([shingled(t) for t in texts])))
    assert len(want) < len(texts)
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, df.withColumn("n_chars", df.doc_id), sf).collect()}
    # Most links here are just above 0.8, where a fingerprint may miss one in 200.
    assert set(want) <= kept and len(kept) - len(want) <= 2


def test_recall_on_whole_tables(spark, sf):
    """Groups of sf0.01 by brute force: none of the pairs from 0.8 up is lost."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == sorted(set(roots([shingled(t) for t in texts])))


@pytest.mark.parametrize("large", [3, 64])
def test_variants_find_what_differs_by_a_bit(monkeypatch, large):
    """In the last round all candidates come whose labels differ; before it, those of every set that has any."""
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng = np.random.default_rng(1)
    sets = [near_dedup.shingles(t) for t in planted()]
    prints = [near_dedup.fingerprint(s) for s in sets]
    label = np.array([n if n % 3 else 0 for n in range(len(sets))])
    i, j = np.triu_indices(len(sets), 1)
    segments, checks = np.array([p[0] for p in prints]), np.array([p[1] for p in prints])
    close = (np.bitwise_count(segments[i] ^ segments[j]) <= 1).any(axis=1) & (label[i] != label[j])
    close &= np.bitwise_count(checks[i] ^ checks[j]) <= near_dedup.CHECK
    want = set(zip(i[close].tolist(), j[close].tolist(), strict=True))
    rows = []
    for node, (own, check, _) in enumerate(prints):
        for at, value in enumerate(own.tolist()):
            low, high = value & 4095, value >> 12
            rows += [((2 * at) << 12 | high, low, node, int(label[node]), check), ((2 * at + 1) << 12 | low, high, node, int(label[node]), check)]
    rows = [rows[x] for x in rng.permutation(len(rows))]
    types = {"half": pa.int32(), "rest": pa.int32(), "node": pa.int64(), "label": pa.int64()}
    columns = {c: pa.array([r[n] for r in rows], t) for n, (c, t) in enumerate(types.items())}
    batch = pa.RecordBatch.from_pydict(columns | {"check": pa.array(np.array([r[4] for r in rows]).view(np.int64))})

    def given(most):
        out = [x for b in near_dedup._variants(most)(iter([batch])) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
        return {x for x in out if x[1] is not None}, {a for a, b in out if b is None}

    assert given(None) == (want, set())
    few, more = given(1)
    # What is left out is told by its nodes.
    assert few < want and {n for pair in want - few for n in pair} <= more and len(few) <= 2 * len(sets)



def test_shape_follows_the_rows():
    assert near_dedup.shape_of(0) == near_dedup.Shape() and near_dedup.shape_of(10**9) == near_dedup.Shape(144, 32)


def test_wide_segments_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).select("doc_id").collect())
    narrow = kept()
    monkeypatch.setattr(near_dedup, "FEW", 10)
    assert len(set(narrow) ^ set(kept())) <= 2


def test_odd_rows(odd, nothing):
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in near_dedup.drop_near_duplicates(odd).collect())
    assert ids == [-5, -1, 1, 3, 4, 4, 5, 6, 8, 9]
    assert near_dedup.drop_near_duplicates(nothing).count() == 0


def test_no_text_leaves_with_another_of_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(300)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (7, a), (7, d), (7, d), (9, d)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "b"), (0, "c"), (1, "a"), (7, "d"), (7, "d")]
