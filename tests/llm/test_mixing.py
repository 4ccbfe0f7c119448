import pytest
from pyspark.sql import functions as F

from venuescope.llm import mixing
from venuescope.llm.queries import QUERIES


def test_targets_stop_at_twice_the_size():
    got = mixing.capped_targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315)
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(315) and got["b"] == pytest.approx(2 * got["c"]) or got["b"] == 200
    assert mixing.capped_targets({"a": 0}, {"a": 5}, 0) == {"a": 0}


def cost(flow, supply):
    """Cheapest way to use so many words of every pattern."""
    used = {}
    for (p, _), n in flow.items():
        used[p] = used.get(p, 0) + n
    return sum(max(0, n - supply[p]) for p, n in used.items())


def test_flow_meets_quotas_at_least_cost():
    supply = {("a",): 10, ("b",): 4, ("a", "b"): 6}
    flow = mixing.min_cost_flow(supply, {"a": 12, "b": 8})
    assert sum(n for (_, s), n in flow.items() if s == "a") == 12 and sum(n for (_, s), n in flow.items() if s == "b") == 8
    best = min(max(0, 12 - x - 10) + max(0, 8 - y - 4) + max(0, x + y - 6) for x in range(13) for y in range(9) if x + y <= 12 and 12 - x <= 20 and 8 - y <= 8)
    assert cost(flow, supply) == best == 0
    tight = mixing.min_cost_flow({("a",): 5}, {"a": 50})
    assert tight == {(("a",), "a"): 10}


def test_query_shape(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k")).orderBy("source").collect()
    want = mixing.capped_targets({r.source: r.n for r in sums}, {r.source: (5, 2, 1)[i % 3] for i, r in enumerate(sums)}, 1.5 * sum(r.n for r in sums))
    for r in sums:
        assert r.n == r.s and r.t == pytest.approx(want[r.source]) and abs(r.k - r.t) <= 1
    assert rows.where("taken > 2 * size or taken < 0").count() == 0
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(5))
    assert again.select("doc_id", "taken").exceptAll(rows.select("doc_id", "taken")).count() == 0


def test_overlapping_sources(spark):
    docs = spark.range(300).selectExpr("id doc_id", "concat('w', id, ' x y') text", "case when id % 3 = 0 then array('a') when id % 3 = 1 then array('b') else array('a', 'b') end m")
    rows = mixing.mix(docs, members=F.col("m"))
    assert rows.agg(F.sum("taken")).first()[0] == pytest.approx(1.5 * 900, abs=4) and rows.where("taken > 6").count() == 0


def test_taken_against_brute_force(spark, sf, rows_of):
    """Each source takes whole rounds of its documents, then those first by the seeded place, the last one cut."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = {r.doc_id: (r.place, r.check) for r in docs.select("doc_id", *mixing._places(11, "doc_id", "text")).collect()}
    sizes, by = {}, {}
    for i, text, source in rows_of(sf, "documents", "doc_id", "text", "source"):
        sizes[i] = len((text or "").encode().split())
        by.setdefault(source, []).append(i)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    left, total = {s: sum(sizes[i] for i in by[s]) for s in names}, 1.5 * sum(sizes.values())
    heft, targets = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}, {}
    while True:
        unit = (total - sum(targets.values())) / sum(heft[s] for s in names if s not in targets)
        over = [s for s in names if s not in targets and unit * heft[s] > 2 * left[s]]
        if not over:
            break
        targets |= {s: 2.0 * left[s] for s in over}
    targets |= {s: unit * heft[s] for s in names if s not in targets}
    want = {}
    for s in names:
        rounds, rest = divmod(round(targets[s]), left[s])
        for i in sorted(by[s], key=lambda i: (place[i][0] % (1 << 64), place[i])):
            part = min(rest, sizes[i])
            want[i], rest = rounds * sizes[i] + part, rest - part
    got = {r.doc_id: r for r in QUERIES["op5_mixing"](spark, sf).collect()}
    source = {i: s for s, own in by.items() for i in own}
    assert {i: r.taken for i, r in got.items()} == want
    assert all(r.size == sizes[i] and r.source_size == left[source[i]] and r.target == pytest.approx(targets[source[i]]) for i, r in got.items())


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 8, 9), (2, "d e", "s", 1, 2, 3)], "doc_id long, text string, source string, __words int, place int, taken int")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {(r.doc_id, r["__words"], r.place, r.taken) for r in mixed.collect()} == {(1, 7, 8, 9), (2, 1, 2, 3)}


def test_too_many_patterns_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(spark.createDataFrame([(i, "a", f"s{i}") for i in range(3)], "doc_id long, text string, source string"))


def test_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 13 and all(r.taken == 0 for r in rows if r.size == 0)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=4)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns and mixing.mixed_rows(nothing).count() == 0


def test_cut_copies_keep_their_first_words(spark):
    docs = spark.createDataFrame([(1, "  a\tb  c d ", "s"), (2, "e f g h", "t")], "doc_id long, text string, source string")
    mixed = mixing.mixed_rows(docs, share=1.25).orderBy("doc_id", F.desc(F.length("text"))).collect()
    words = [len(r.text.split()) for r in mixed]
    assert sum(words) == 10 and all(r.text in ("  a\tb  c d ", "  a\tb", "  a\tb  c", "  a", "e f g h", "e f", "e f g", "e") for r in mixed)
