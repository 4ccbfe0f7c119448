"""CSV in byte ranges gives the rows of one task, wherever the ranges are cut."""

import random

import pytest
from pyspark.sql import functions as F

from venuescope.sources import files, kept, records


def rows_of(spark, path, size, **how):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, (str(size), "0"), strict=True):
        spark.conf.set(n, value)
    try:
        df = files.read_csv(spark, path, **how)
        return sorted(map(tuple, df.collect()), key=repr), sorted(r.line for r in files.broken_rows(spark, path, **how).collect()), df.rdd.getNumPartitions()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


ADVERSE = 'id,text,n\n1,"a\nb",x\n2,plain "quoted" text,y\n3,"two ""doubled"" and\n""\n,still in",z\n\n4,"",\n5,"x"y,1\n6,"open, ""\n""",2\n7,a,b,c,d\n8,short\n9,"end"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cut_at_every_offset(spark, tmp_path, end):
    path = tmp_path / "a.csv"
    path.write_bytes(ADVERSE.replace("\n", end).encode())
    want = rows_of(spark, str(path), 1 << 20, split=False)[:2]
    for size in (1 << 20, 13):
        assert rows_of(spark, str(path), size)[:2] == want, size


def line_by_line(data: bytes, escape: bytes):
    """Records by one look at all bytes, and those that the cutter makes of any three ranges of lines."""
    lines = data.split(b"\n")
    out, state, held = [], records.OUTSIDE, []
    for x in lines:
        held.append(x)
        state = records.after(x, state, escape)
        if state == records.OUTSIDE:
            out.append(b"\n".join(held))
            held = []
    return out + ([b"\n".join(held)] if held else [])


def test_both_states_of_every_range():
    import pyarrow as pa

    draw = random.Random(2)
    for escape in (b'"', b"\\"):
        for _ in range(300):
            lines = ["".join(draw.choice('a,"\\ ') for _ in range(draw.randrange(8))).encode() for _ in range(draw.randrange(1, 12))]
            want = line_by_line(b"\n".join(lines), escape)
            cut = sorted(draw.randrange(len(lines) + 1) for _ in range(2))
            state, got, piece = records.OUTSIDE, [], []
            for low, high in zip([0, *cut], [*cut, len(lines)], strict=True):
                own = lines[low:high]
                if not own:
                    continue
                c = records.Cutter(state, escape)
                done = []
                for at in range(0, len(own), 3):
                    done += c.records(pa.array(own[at : at + 3], pa.binary()))
                piece += c.head
                if c.started and piece:
                    got.append(b"\n".join(piece))
                    piece = []
                elif c.state == records.OUTSIDE and piece and not c.started:
                    got.append(b"\n".join(piece))
                    piece = []
                got += done
                if c.started and c.state == records.INSIDE:
                    piece = list(c.open)
                state = c.state
            if piece:
                got.append(b"\n".join(piece))
            assert got == want, (lines, cut)


def test_one_large_file_has_many_tasks(spark, tmp_path):
    draw = random.Random(1)
    rows = [(str(n), "".join(draw.choice('ab\n", é') for _ in range(draw.randrange(60)))) for n in range(4000)]
    path = tmp_path / "big.csv"
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    path.write_text("id,text\n" + "".join(f"{i},{quoted(t)}\n" for i, t in rows), newline="")
    got, broken, tasks = rows_of(spark, str(path), 12000)
    assert got == sorted(rows, key=repr) and not broken and tasks > 10


def test_backslashes_code_page_and_carriage_returns(spark, tmp_path):
    slashed = tmp_path / "s.csv"
    slashed.write_bytes(('place,text\n' + 'A,"He said \\"hi,\nthere\\", ok"\n' * 50).encode())
    assert rows_of(spark, str(slashed), 400, escape="\\")[0] == [("A", 'He said "hi,\nthere", ok')] * 50
    korean = tmp_path / "k.csv"
    korean.write_bytes(('상호명,리뷰\n' + '카페,"좋다\n또, 온다"\n' * 40).encode("cp949"))
    assert rows_of(spark, str(korean), 333)[0] == [("카페", "좋다\n또, 온다")] * 40
    old = tmp_path / "o.csv"
    old.write_bytes(b'a,b\r1,"x,\ry"\r2,z\r')
    assert rows_of(spark, str(old), 9)[0] == [("1", "x,\ny"), ("2", "z")]  # a line end within a text is a line feed


def test_several_files_and_groups(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.csv").write_text(f'id,text\n{n},"a\nb"\n')
    assert rows_of(spark, str(tmp_path), 6)[0] == [(str(n), "a\nb") for n in range(4)]
    assert records.in_groups({"a": 10, "b": 25, "c": 100, "d": 1}, 10, 6) == [["a"], ["b"], ["c"], ["d"]]
    assert records.in_groups({"a": 10, "b": 25, "c": 1}, 10) == [["a", "b", "c"]]


def test_only_own_tables_are_removed(spark, monkeypatch):
    # In a part of the folder of its own, as other tests still read their tables.
    monkeypatch.setattr(kept, "FOLDER", "venuescope-apart")
    other = f"{kept.shared_dir(spark)}/{kept.FOLDER}/another-application"
    spark.range(2).write.parquet(other)
    assert kept.written(spark.range(3), "t").count() == 3
    assert kept.remove_written(spark) and not kept.remove_written(spark) and spark.read.parquet(other).count() == 2


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    busy = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    path = str(tmp_path / "one.parquet")
    spark.range(20_000).withColumn("t", F.sha2(F.col("id").cast("string"), 512)).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    assert busy(kept.spread(table)) == 1  # too small to be worth it
    monkeypatch.setattr(kept, "WORTH", 1000)
    assert busy(table) == 1 and busy(kept.spread(table)) == spark.sparkContext.defaultParallelism
    assert kept.spread(table).agg(F.sum("id")).first()[0] == sum(range(20_000))
    monkeypatch.setattr(kept, "MANY", 0)
    assert busy(kept.spread(table)) == 1  # a table of many splits is not looked at
