from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dedup import roots, shingled
from venuescope.llm import line_dedup, mixing, toxicity


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, sf)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        if name != "packing":
            assert kept.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text or "") < 0.5}
        elif name == "line_dedup":
            texts = {r.doc_id: r.text for r in line_dedup.line_dedup(before).collect()}
            assert {r.doc_id: r.text for r in kept.collect()} == texts
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        elif name == "near_dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i][0] for i in roots([shingled(t) for _, t in rows])})
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
            words = {}
            for r in kept.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
            assert words == {i: n for i, n in taken.items() if n}
        else:
            assert kept.agg({"length": "sum"}).first()[0] > 0


def packed_well(rows, docs):
    """Every id of every document that mixing has kept lies in one piece, and sequences are without gaps."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(by) == {d.doc_id for d in docs}
    for i, pieces in by.items():
        copies = sum(d.doc_id == i for d in docs)
        assert sum(n for _, n, _ in pieces) == sum(t for s, _, t in pieces if s == 0) and sum(s == 0 for s, _, _ in pieces) == copies


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((own := stage(spark, docs, sf)).collect(), own.schema)
    packed_well(corpus_pipeline.run(spark, sf).collect(), docs.collect())


def test_odd_rows(spark, odd, sf):
    docs, kept = odd, []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((own := stage(spark, docs, sf)).collect(), own.schema)
        kept.append(docs.collect())
    # Of the copies of "One" and of the two long texts one stays; a text without words takes nothing of the mix.
    assert [len(k) for k in kept[:2]] == [len(kept[0])] * 2 and {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]} <= {r.doc_id for r in kept[0]}
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if (r.text or "").split()} and not {7, 10_000_000_000} & {r.doc_id for r in kept[2]}
    packed_well(kept[4], kept[3])


def test_no_stage_touches_other_columns(spark, sf, clashing):
    """Every stage that returns documents, on rows with the names that are used inside."""
    whole = {r["c0"]: r for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        # `n_chars` follows the text where a stage changes it.
        out = stage(spark, clashing, sf)
        assert out.columns[: len(clashing.columns)] == clashing.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            was = whole[r["c0"]]
            assert [r[c] for c in clashing.columns if c != "text"] == [was[c] for c in clashing.columns if c != "text"], name
            assert name in ("line_dedup", "mixing") or r.text == was.text
    kept = corpus_pipeline.remove_near_duplicates(spark, clashing, sf).collect()
    assert sorted(r["c0"] for r in kept) == ["c01", "c02", "c03", "c04", "c05", "c06", "c08", "c09"]
    lines = {r["c0"]: r.text for r in corpus_pipeline.remove_repeated_lines(spark, clashing, sf).collect()}
    assert len(lines) == 10 and lines["c08"] == whole["c08"].text and lines["c09"] == "short"


def test_rows_alike_are_taken_by_their_own_takes(spark):
    rows = [(7, "a b c", "s", n) for n in range(3)] + [(8, "d e f g", "s", 9), (9, "x " * 40, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    want = {r.source: r.words for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    got = {r.source: r.words for r in mixing.mixed_rows(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words")).collect()}
    assert got == {s: n for s, n in want.items() if n}
