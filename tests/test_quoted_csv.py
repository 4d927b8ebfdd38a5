"""Quoted CSV read in splits equals Spark's whole-file reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F, types as T

from catalytics.sources import files, quoted_csv

SCHEMA = files.string_schema(["a", "b", "c"])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", header=True):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerows([["a", "b", "c"]] * header + rows)


def field(rng):
    return rng.choice(["", "plain", "x\ny", 'say "hi"', "\n\n", 'a,b\n"c"\n', "é\n", "long " * 40, "line\n" * 60, '""', "\r\ninside"])


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [[str(i), field(rng), field(rng)] for i in range(n)]


def both(spark, path, header=True):
    got = quoted_csv.read(spark, path, SCHEMA, header)
    want = spark.read.schema(SCHEMA).csv(path, header=header, multiLine=True, escape='"')
    return got, want


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_equals_the_whole_file_reader(spark, small_splits, tmp_path, seed, end):
    for k in range(3):
        write(tmp_path / f"part-{k}.csv", rows_of(10 * seed + k), end)
    (tmp_path / "empty.csv").write_text("")
    write(tmp_path / "header.csv", [])
    got, want = both(spark, str(tmp_path))

    def plain(df):  # Spark's reader takes a file's line ends for line breaks within its fields, too
        return sorted([tuple(v and (v.replace("\r\n", "\n") if end == "\r\n" else v) for v in r) for r in df.collect()], key=str)

    assert plain(got) == plain(want) and got.count() == 360


def test_one_file_is_read_by_several_tasks(spark, small_splits, tmp_path):
    path = tmp_path / "one.csv"
    write(path, rows_of(5))
    found = quoted_csv.lines(spark.read.text(str(path), lineSep="\n"))
    assert found.rdd.getNumPartitions() > 8
    states = quoted_csv.split_states(found).collect()
    assert len({r["split"] for r in states}) > 8 and {r["inside"] for r in states} == {True, False}


def test_a_record_longer_than_several_splits(spark, small_splits, tmp_path):
    path = tmp_path / "one.csv"
    rows = [["1", "x\n" * 2000, "end"], ["2", "b", "c"], ["3", "\n".join(['"q"'] * 500), ""]]
    write(path, rows)
    assert sorted(tuple(r) for r in quoted_csv.read(spark, str(path), SCHEMA).collect()) == [("1", "x\n" * 2000, "end"), ("2", "b", "c"), ("3", rows[2][1], None)]


def test_without_header_blank_lines_and_an_open_end(spark, small_splits, tmp_path):
    (tmp_path / "x.csv").write_text('1,a,b\n\n   \n2,"c\nd",e\n3\n4,a,b,more\n5,"open\nend')
    got = sorted((tuple(r) for r in quoted_csv.read(spark, str(tmp_path), SCHEMA, header=False).collect()), key=str)
    assert got[:4] == [("1", "a", "b"), ("2", "c\nd", "e"), ("3", None, None), ("4", "a", "b")]
    assert got[4][0] == "5" and got[4][1].startswith("open\nend")


def test_header_over_several_lines(spark, small_splits, tmp_path):
    (tmp_path / "x.csv").write_text('a,"b\n' + "more of it\n" * 50 + '",c\n1,2,3\n')
    assert [tuple(r) for r in quoted_csv.read(spark, str(tmp_path), SCHEMA).collect()] == [("1", "2", "3")]


def test_files_are_read_twice_for_their_records(spark, small_splits, tmp_path):
    """The states of the splits are found by one read and written; whole records and fragments each take one more."""
    write(tmp_path / "part.csv", rows_of(5))
    found = quoted_csv.records(spark.read.text(str(tmp_path), lineSep="\n"))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 2


def test_the_pass_for_fragments_gives_no_whole_records():
    import pyarrow as pa
    text = ['end of one"', "b,1", "c,2", 'd,"open']
    batch = pa.RecordBatch.from_arrays([pa.array(text), pa.array([True, False, False, True]), pa.array([3] * 4), pa.array([True] * 4),
                                        pa.array([False] * 4)], ["line", "odd", "number", "inside", "top"])
    sides = {wholes: [(s, r) for b in quoted_csv._assemble(iter([batch]), wholes) for s, r in zip(b["side"].to_pylist(), b["record"].to_pylist())]
             for wholes in (True, False)}
    assert sides == {True: [(1, "b,1"), (1, "c,2")], False: [(0, text[0]), (2, text[3])]}


def test_compressed_files_are_a_split_each_and_not_read_for_fragments(spark, small_splits, tmp_path):
    rows = rows_of(6)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    files.write_csv(df, str(tmp_path / "gz"), rows_per_gzip=50)
    files.write_csv(df, str(tmp_path / "plain"))
    assert len(list((tmp_path / "gz").glob("*.csv.gz"))) == 3 and not list((tmp_path / "plain").glob("*.gz"))
    got = quoted_csv.records(spark.read.text(str(tmp_path / "gz"), lineSep="\n"))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    want = sorted(map(tuple, both(spark, str(tmp_path / "plain"))[1].collect()), key=str)
    assert len(want) == 120
    for folder in ("gz", "plain"):
        assert sorted(map(tuple, quoted_csv.read(spark, str(tmp_path / folder), SCHEMA).collect()), key=str) == want


def test_a_compressed_file_that_ends_within_quotes(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write('a,b,c\n1,"x\ny",z\n2,"open\nend')
    assert sorted(tuple(r)[:2] for r in quoted_csv.read(spark, str(tmp_path), SCHEMA).collect()) == [("1", "x\ny"), ("2", "open\nend")]
