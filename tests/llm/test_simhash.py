import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from venuescope.llm import components, simhash
from venuescope.llm.queries import QUERIES


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(fps):
    x = np.array(fps, np.uint64)
    return np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))


def majority(text):
    """The contract's fingerprint, worked out apart from the operator: words, shingles, hashes and bits."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_against_brute_force(spark, sf, rows_of):
    docs = sorted(rows_of(sf, "documents", "doc_id", "text"))
    fps = [majority(t or "") for _, t in docs]
    assert all(simhash.fingerprint(t) == majority(t) for t in ("", " ", "A", "a B", "É b\x0bC D d", "x y z " * 50))
    ids = [i for i, _ in docs]
    want = {ids[i]: ids[r] for i, r in enumerate(roots(len(ids), near(fps)))}
    got = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, sf).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in zip(ids, fps, strict=True))


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for k in range(1, 6):
            for _ in range(6):
                fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(), i) for i, f in enumerate(fps)], "fp long, first long")
    found = simhash.links(df)
    x = np.array(fps, np.uint64)
    assert all(int(x[r.a] ^ x[r.b]).bit_count() <= 3 for r in found.collect())
    want = roots(len(fps), near(fps))
    got = {r.node: r.root for r in components.components(found).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_large_variants_lose_no_link():
    rng = np.random.default_rng(2)
    x = np.unique((rng.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(40)) | np.uint64(77))
    parts = list(simhash._large(x, 0, 3))
    got = roots(len(x), [p for a, b in parts for p in zip(a, b, strict=True)])
    assert got == roots(len(x), near(x))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, nothing):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == 0 and by[2].component_id == 1 and by[10_000_000_000].component_id == 3
    assert by[7].component_id == 6 and by[None].component_id is None
    assert simhash.simhash_groups(nothing).count() == 0


def test_case_and_blanks():
    f = simhash.fingerprint
    assert f("A b C") == f("a  B\tc") and f("") == f(" \n") == 0 and f("É b c") != f("é b c")
    assert simhash.fingerprints.__doc__ and F is not None
