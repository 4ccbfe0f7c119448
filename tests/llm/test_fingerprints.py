import hashlib

from pyspark.sql import functions as F

from venuescope.llm import fingerprints as fp
from venuescope.llm.queries import QUERIES


def shingles(text, width=5):
    words = [w for w in text.lower().replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def test_query_against_brute_force(spark, sf, rows_of):
    docs = sorted((i, t or "") for i, t in rows_of(sf, "documents", "doc_id", "text"))
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    misses = []
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = shingles(text), shingles(other)
            misses.append(near - len(a & b) / len(a | b))
            assert 0 <= near <= 1
    assert max(map(abs, misses)) < 0.35 and sum(map(abs, misses)) / len(misses) < 0.02


def test_odd_rows(odd, nothing):
    rows = fp.edited_texts(odd).select("doc_id", "n_chars", "edited", fp.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near"), fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("next")).collect()
    assert len(rows) == 13 and all(0 <= r.near <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].edited == "" and by[1].near == 1 and by[1].next == 1
    assert by[6].next > 0.9
    assert by[None].edited[:10] == "A row with" and by[10_000_000_000].edited == "OnA"
    assert fp.edited_texts(nothing).count() == 0
    alone = fp.edited_texts(odd.where("doc_id = 3")).collect()
    assert [r.edited for r in alone] == ["OnO"]


def test_sparse_ids(spark):
    docs = spark.range(50).select((F.col("id") * 100_003 - 900_000).alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    got = {r.text: r.edited for r in fp.edited_texts(docs).collect()}
    assert all(got[f"w{i}"] == f"w{i}"[: len(f"w{i}") - len(f"w{i}") // 2] + f"w{(i + 1) % 50}"[: len(f"w{i}") // 2] for i in range(50))


def test_ranges_of_any_ids(spark, monkeypatch):
    """Hashed ids, repeated ones and many rows without one; the ranges are as even as the ids."""
    import random

    monkeypatch.setattr(fp, "_ranges", lambda rows, real=fp._ranges: real(rows, 8))
    rng = random.Random(2)
    rows = [(rng.randrange(-(1 << 63), (1 << 63) - 1), f"text {i} of hashed ids") for i in range(400)]
    rows += [(rows[5][0], f"again {i}") for i in range(10)] + [(None, f"nameless {i}") for i in range(300)]
    for own in (rows, rows[:400], rows[410:]):
        df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
        follows = {r.text: r.next_text for r in fp.with_next(fp.keyed(df), ["text"]).collect()}
        at, seen = own[0][1], []
        while at not in seen:
            seen.append(at)
            at = follows[at]
        ids = [dict((t, i) for i, t in own)[t] for t in seen]
        turn = ids.index(min((i for i in ids if i is not None), default=None))
        ids = ids[turn:] + ids[:turn]
        assert len(seen) == len(own) and (None not in ids[: sum(i is not None for i in ids)] or ids[0] is None)
        known = [i for i in ids if i is not None]
        assert known == sorted(known)
    sizes = fp.keyed(spark.createDataFrame(rows[:400], "doc_id long, text string"))
    assert max(r["count"] for r in sizes.groupBy(fp._ranges(sizes)[1]).count().collect()) < 40


def test_merging_and_containment(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"b{i}" for i in range(200))
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    s = {c: fp.sketch(F.col(c)) for c in "abc"}
    row = df.select(fp.containment(s["b"], s["c"]).alias("b_in_c"), fp.containment(s["c"], s["b"]).alias("c_in_b"), F.array_except(fp.merged(s["a"], s["b"]), s["c"]).alias("extra"), fp.likeness(s["a"], s["b"]).alias("none")).first()
    assert row.b_in_c == 1 and row.c_in_b < 0.15 and row.extra == [] and row.none == 0


def test_far_and_crowded_ids_share_ranges(spark):
    """What one id far away, or clusters, do to ranges: none has many times its share."""
    for ids in ([*range(20_000), 1 << 60], [*range(-(1 << 63), -(1 << 63) + 10_000), *range(10_000), (1 << 63) - 2], list(range(20_000)), [7] * 3):
        rows = spark.createDataFrame([(i, "") for i in ids], "key long, text string")
        place, of = fp._ranges(rows)
        sizes = [r["count"] for r in rows.groupBy(of.alias("r")).count().collect()]
        assert max(sizes) <= 2 * fp.PER_RANGE
        ordered = [r.r for r in rows.select("key", of.alias("r")).orderBy("key").collect()]
        assert ordered == sorted(ordered)
