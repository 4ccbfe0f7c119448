import json

import pytest
from pyspark.sql import functions as F

from venuescope.sources import files
from venuescope.streaming import progress


@pytest.fixture
def csv(tmp_path):
    def make(name, content, encoding):
        path = tmp_path / name
        path.write_bytes(content.encode(encoding))
        return str(path)

    return make


REVIEWS = '상호명,리뷰\n카페,"좋다\n또 온다"\n역,"a, b"\n'


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_encodings_and_line_ends(spark, csv, encoding):
    df = files.read_csv(spark, csv("r.csv", REVIEWS, encoding))
    assert df.columns == ["상호명", "리뷰"]
    assert [tuple(r) for r in df.collect()] == [("카페", "좋다\n또 온다"), ("역", "a, b")]


def test_projection_and_parts(spark, csv):
    a, b = csv("a.csv", "review_index,place\n2,x\n1,y\n", "utf-8"), csv("b.csv", "review_index,place\n0,z\n", "utf-8")
    assert files.read_csv(spark, a, ["place"]).columns == ["place"]
    assert [r.place for r in files.read_parts(spark, [a, b]).collect()] == ["z", "y", "x"]
    assert files.first_existing(spark, ["/nowhere/x.csv", b, a]) == b and files.first_existing(spark, ["/nowhere"]) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok')], "n int, t string")
    paths = files.write_scores({"factors": df, "places": df}, str(tmp_path), "llm", "_part1")
    assert set(paths) == {"factors", "places"} and paths["places"].endswith("llm_places_part1")
    back = spark.read.option("header", True).option("escape", '"').csv(paths["factors"]).first()
    assert tuple(back) == ("1", 'say "hi", ok')
    files.write_csv(df, str(tmp_path / "bom"), bom=True)
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "bom").glob("part*"))


ODD_VALUES = [("A", 'He said "hi, there", ok', "1"), ("B", 'ends "quoted"', "2"), ("C", "two\nlines, and\r\nthree", "3"), ("D", "back\\slash \\", " 4 "), ("E", "", "5"), ("F", None, "6"), ("G", '"', ",")]


def test_what_is_written_reads_back(spark, tmp_path):
    df = spark.createDataFrame(ODD_VALUES, "place string, text string, n string")
    path = files.write_csv(df.coalesce(1), str(tmp_path / "odd"))
    assert [tuple(r) for r in files.read_csv(spark, path).collect()] == ODD_VALUES
    assert files.broken_rows(spark, path).count() == 0


def test_both_quoting_styles_and_broken_rows(spark, csv):
    doubled = csv("a.csv", 'place,text,n\nA,"He said ""hi, there"", ok",1\nB,"ends ""quoted""",2\nC,x,3,too,many\nD,short\n', "utf-8")
    assert [tuple(r) for r in files.read_csv(spark, doubled).collect()] == [("A", 'He said "hi, there", ok', "1"), ("B", 'ends "quoted"', "2"), ("D", "short", None)]
    assert [r.line for r in files.broken_rows(spark, doubled).collect()] == ["C,x,3,too,many"]
    slashed = csv("b.csv", 'place,text\nA,"He said \\"hi, there\\", ok"\n', "utf-8")
    assert [tuple(r) for r in files.read_csv(spark, slashed, escape="\\").collect()] == [("A", 'He said "hi, there", ok')]


def test_encoding_is_told_by_all_bytes_of_every_file(spark, tmp_path):
    folder = tmp_path / "mixed files"
    folder.mkdir()
    filler = "x" * 100 + ",y\n"
    (folder / "late.csv").write_bytes(("a,b\n" + filler * 12_000 + "카페,좋다\n").encode("cp949"))
    (folder / "plain é.csv").write_bytes("a,b\n역,멀다\n".encode())
    rows = files.read_csv(spark, str(folder)).where("length(a) < 50").collect()
    assert sorted(tuple(r) for r in rows) == [("역", "멀다"), ("카페", "좋다")]


def test_log(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps({"reviews": [{"review_index": 4}, {"review_index": "x"}]}) + "\n\n{broken\n" + json.dumps({"reviews": [{"review_index": "9"}]}) + "\n")
    lines = files.read_lines(spark, str(log))
    assert lines.count() == 3 and sorted(r.review_index for r in files.done_reviews(lines).collect()) == [4, 9]
    config = tmp_path / "c.json"
    config.write_text('{"a": {"b": "c"}}')
    assert files.read_json_config(spark, str(config)) == {"a": {"b": "c"}}


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "ts timestamp, place string, factor string, hint string"
    put = lambda n, h: (folder / f"{n}.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00", "place": "A", "factor": "f", "hint": h}) + "\n")
    put(1, "positive")
    for n in (2, 3):
        progress.appended(progress.watched(spark, str(folder), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        put(n, "negative")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = progress.running_scores(progress.watched(spark, str(folder), schema)).writeStream.outputMode("complete").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("scores").select("mentions", F.round("score", 3).alias("s")).first()
    assert (row.mentions, row.s) == (3, -0.333)


def test_results_are_remembered_by_version_and_arguments(spark, tmp_path):
    made = []

    def numbers(n):
        made.append(n)
        return spark.range(n)

    for args, version in (((3,), "1"), ((3,), "1"), ((4,), "1"), ((3,), "2")):
        assert files.remembered(spark, str(tmp_path), numbers, *args, version=version).count() == args[0]
    assert made == [3, 4, 3]
    for now in (0.0, 59.0, 60.0, 61.0):
        files.remembered(spark, str(tmp_path), numbers, 5, seconds=60, now=lambda now=now: now)
    assert made == [3, 4, 3, 5, 5]
