"""CSV read by byte ranges against Python's csv, with borders everywhere."""

from __future__ import annotations

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import types as T

from casework.sources import csv_ranges as C
from casework.sources import readers as R


def plain(text, columns):
    csv.field_size_limit(1 << 30)
    # Blank lines before the header are skipped, as pandas does; DictReader would take the first as the header.
    rows = csv.DictReader(io.StringIO(text.lstrip("\r\n"), newline=""))
    return [tuple(r.get(c) or None for c in columns) for r in rows]


def test_open_cells_are_followed_as_csv_does():
    """A text ends inside a cell exactly when a line more would continue the record."""
    r = random.Random(2)
    for _ in range(20_000):
        inside = r.random() < 0.5
        line = "".join(r.choice('a,"\r ') for _ in range(r.randrange(9)))
        whole = ('"x\n' if inside else "") + line
        rows = list(csv.reader(io.StringIO(whole + "\n#", newline="")))
        assert C.ends_inside(line, inside) == (not (rows and rows[-1] == ["#"])), (line, inside)


def texts():
    r = random.Random(4)
    cell = lambda: r.choice(("", "x", "é", "a b", '"q,\n"', '"two\n\nlines"', '"d""q"', '"\n"', 'm"id', '""', '"a\r\nb"', "7", '" ""\n"" "', '"x"y'))
    for k in range(4):
        end = r.choice(("\n", "\r\n"))
        body = "".join(",".join(cell() for _ in range(r.choice((3, 3, 3, 2)))) + end + (end if r.random() < 0.1 else "") for _ in range(7))
        yield f"a,b,c{end}{body}" if k % 2 else f'"a",b,"c"{end}{body}'.rstrip("\r\n")
    yield '\n\n"a\nx",b,c\n1,2,3\n'
    yield 'a,b,c\n1,"open to the end\n2,3,4\n5'
    yield "a,b,c"
    yield ""
    yield 'a,b,c\n' + '1,"' + "long\n" * 12 + '",3\n' + "4,5,6\n"


def cut(spark, files, most, seed):
    """The lines of the files in ranges of at most ``most`` lines, as the reader gets them."""
    r, rows = random.Random(seed), []
    for i, text in enumerate(files):
        begin, left, block = 0, 0, 0
        lines = text.split("\n")
        for line in lines if lines[-1] else lines[:-1]:
            if not left:
                block, left = begin, r.randint(1, most)
            rows.append((line, f"{i:02d}.csv", block))
            begin += len(line.encode()) + 1
            left -= 1
    return spark.createDataFrame(rows, "value string, file string, block long").coalesce(1)  # a range lies in one task


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_every_border(spark, monkeypatch, most):
    files = list(texts())
    want = [row for text in files for row in plain(text, ["c", "a", "b"])]
    monkeypatch.setattr(C, "lines", lambda spark, path: cut(spark, files, most, most))
    got = R.read_csv_in_order(spark, "", ["c", "a", "b"], "n").collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r.n)] == [(*row, i) for i, row in enumerate(want, 1)]


def test_long_borders_are_read_again(spark, monkeypatch):
    files = ['a,b,c\n' + '1,"' + "long\n" * 30_000 + '",3\n' + "4,5,6\n", 'a,b,c\n1,"' + "x" * 100_000 + '\n",2\n']
    monkeypatch.setattr(C, "lines", lambda spark, path: cut(spark, files, 9000, 1))
    called = []
    second = C._second_scan
    monkeypatch.setattr(C, "_second_scan", lambda df, inside, fragments: called.append(fragments) or second(df, inside, fragments))
    got = R.read_csv_in_order(spark, "", ["a", "b", "c"], "n").orderBy("n").collect()
    assert [tuple(r)[:3] for r in got] == [row for text in files for row in plain(text, ["a", "b", "c"])] and True in called


def test_one_file_many_tasks(spark, tmp_path):
    rows = [(f"{i:07d}", f'say "{i}",\n{"é" * (i % 50)}\r\nend' if i % 3 else None, str(i * i)) for i in range(20_000)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows([("key", "text", "n"), *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100000")
    try:
        got = R.read_csv_in_order(spark, str(tmp_path), ["key", "text", "n"], "at")
        assert got.rdd.getNumPartitions() > 8
        assert [tuple(r) for r in sorted(got.collect(), key=lambda r: r["at"])] == [(*r, i) for i, r in enumerate(rows, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_each_file_has_its_own_header(spark, tmp_path):
    people = {"a": "first_name,classification,n\nANA,F,3\nRUI,M,\n", "b": "classification,n,first_name\nF,5,BEA\nM,x,IVO,\nM,2,\nF,1,EVA,more\n", "c": "﻿n,first_name\n9,LIA\n"}
    for name, text in people.items():
        (tmp_path / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
    schema = T.StructType([T.StructField("first_name", T.StringType()), T.StructField("classification", T.StringType()), T.StructField("n", T.LongType())])
    got = R.read_gzip_csv(spark, str(tmp_path), schema, skip_bad_lines=True)
    # A field too many drops the row even where it is empty; a short row stays.
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("ANA", "F", 3), ("RUI", "M", None), ("BEA", "F", 5), (None, "M", 2), ("LIA", None, 9)], key=str)
    with pytest.raises(Exception, match="more fields than the header"):
        R.read_gzip_csv(spark, str(tmp_path), schema).collect()
    with pytest.raises(Exception, match="more fields than the header"):
        R.read_csv_typed(spark, str(tmp_path), schema).collect()
    assert R.read_csv_strings(spark, str(tmp_path), ["first_name"]).count() == 7


def test_rows_do_not_move(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (R.read_csv_strings(spark, str(tmp_path), ["b"]), R.read_csv_in_order(spark, str(tmp_path), ["b"], "n")):
        text = plan(df)
        assert "Exchange hash" not in text and "Exchange range" not in text and "Exchange Single" not in text and "Exchange Round" not in text
        assert "RDDScan" not in text  # no checkpoint
