"""Closed itemsets and rules against an enumeration of all subsets."""

import random
from itertools import combinations

import numpy as np
import pytest

from venuescope.llm import itemsets


def baskets_of(rows):
    out = {}
    for b, i in rows:
        if b is not None and i is not None:
            out.setdefault(b, set()).add(i)
    return out


def brute(rows, least, share):
    baskets = baskets_of(rows)
    support = {}
    for held in baskets.values():
        for n in range(1, len(held) + 1):
            for s in combinations(sorted(held), n):
                support[s] = support.get(s, 0) + 1
    good = {s: n for s, n in support.items() if n >= least and n * share >= len(baskets)}
    closed = {s: n for s, n in good.items() if not any(n == m and set(s) < set(t) for t, m in good.items())}
    rules = {}
    for s, n in closed.items():
        for c in s if len(s) > 1 else ():
            a, own = good[tuple(x for x in s if x != c)], good[(c,)]
            if 100 * n >= 30 * a and n * len(baskets) > a * own:
                rules[s, c] = (a, own)
    return closed, rules


def made(spark, rows, least, share, **settings):
    df = spark.createDataFrame(rows, "sale_id long, item_id long")
    sets, frequent, baskets = itemsets.itemsets(df, "sale_id", "item_id", least, share, **settings)
    names = {r["items"]: tuple(m["item"] for m in r["members"]) for r in itemsets.with_items(sets, frequent).collect()}
    closed = {names[r["items"]]: r.support for r in sets.collect()}
    assert len(closed) == sets.count()
    rules = {(names[r["items"]], r["item"]): (r.a, r.s) for r in itemsets.rules(sets, frequent, baskets).collect()}
    return closed, rules


def bundles(seed, baskets=150):
    """Baskets with bundles that are bought together always or mostly, singles, repeats, nulls and one that holds everything."""
    draw = random.Random(seed)
    rows = [(0, i) for i in range(14)] + [(0, 3), (None, 3), (5, None), (0, 900)]
    for b in range(1, baskets):
        if draw.random() < 0.5:
            rows += [(b, i) for i in (3, 5, 8, 11)]
        if draw.random() < 0.3:
            rows += [(b, i) for i in (1, 2, 3, 4) if draw.random() < 0.8]
        rows += [(b, draw.randrange(14)) for _ in range(draw.randrange(3))]
    return rows


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"most": 12}), (3, {"most": 3}), (4, {"most": 1})])
def test_against_all_subsets(spark, seed, settings):
    rows = bundles(seed)
    want = brute(rows, 5, 20)
    assert max(map(len, want[0])) > 3
    assert made(spark, rows, 5, 20, **settings) == want


def test_broadcast_or_joined_alike(spark, monkeypatch):
    rows = bundles(5)
    monkeypatch.setattr(itemsets, "SMALL", 0)
    assert made(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_ties_and_bundle_of_many(spark):
    rows = [(b, i) for b in range(15) for i in range(30)]  # one closed set of 30, all supports alike
    closed, rules = made(spark, rows, 12, 10)
    assert closed == {tuple(range(30)): 15}
    assert rules == {}


def test_empty_tables(spark):
    for rows in ([], [(None, 1), (1, None)], [(1, 1)]):
        assert made(spark, rows, 2, 10) == ({}, {})


def test_n_lists():
    tree = itemsets.Tree(np.array([0, 1, 2, 0, 2, 1, 2]), np.array([3, 2, 2]), np.array([2, 3, 4]))
    two = tree.list_of(2)
    assert two[2].tolist() == [2, 3, 4] or sorted(two[2].tolist()) == [2, 3, 4]
    assert itemsets.merged(tree.list_of(0), two)[2].sum() == 5
    assert itemsets.merged(tree.list_of(1), two)[2].sum() == 6
    assert dict(zip(*map(np.ndarray.tolist, tree.above(2)), strict=True)) == {0: 5, 1: 6}
