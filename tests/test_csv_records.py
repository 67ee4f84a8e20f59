"""CSV records with quotes and line breaks, over any number of files and splits."""

import csv
import io
import random

import pytest

from cellarbook.sources import readers, sinks
from cellarbook.sources.records import records


def written(path, table, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(table)
    path.write_bytes(out.getvalue().encode())


def cells(frame):
    return sorted((tuple(v or "" for v in r) for r in frame.collect()), key=str)


def tricky(rng, n):
    pool = ['12" plate, large', "two\nlines", '"', '""', "\n", 'a"\n"b', ",", "x", "", "plain", "é\n\n,", "three\nlines\nof text", "tab\t", 'end"']
    return [[f"k{i}", rng.choice(pool) + rng.choice(pool), rng.choice(pool)] for i in range(n)]


@pytest.mark.parametrize("skip,files,end", [(0, 1, "\n"), (1, 1, "\r\n"), (0, 7, "\n"), (1, 50, "\n")])
def test_cells_come_out_whole(spark, tmp_path, skip, files, end):
    rng, want = random.Random(files), []
    for f in range(files):
        rows = tricky(rng, 40)
        want += [tuple(r) for r in rows]
        junk = [["exported\nby hand", f"{f}", ""]] * skip
        written(tmp_path / f"{f}.csv", [*junk, ["Cod", "Nombre", "Nota"], *rows], end)
    read = readers.read_csv(spark, str(tmp_path), skip=skip)
    assert read.columns == ["Cod", "Nombre", "Nota"]
    assert cells(read) == sorted(want, key=str)
    assert cells(readers.read_csv(spark, str(tmp_path), ["a", "b", "c"], skip)) == sorted(want, key=str)


@pytest.mark.parametrize("block", [64, 257, 1500])
def test_a_file_still_splits(spark, tmp_path, block):
    rows = [["Cod", "Nombre", "Nota"], *tricky(random.Random(block), 400), ["z", "one\n" * 60 + "cell", "last"]]
    written(tmp_path / "a.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    try:
        read = readers.read_csv(spark, str(tmp_path / "a.csv"))
        assert records(spark, str(tmp_path / "a.csv")).select("_block").distinct().count() > 3
        assert cells(read) == sorted((tuple(r) for r in rows[1:]), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_stray_quotes_do_not_open_a_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Cod,Nombre\n1,5" pipe\n2,a "b" c\n\n3,"whole"\n4, "x\n')
    assert cells(readers.read_csv(spark, str(tmp_path / "a.csv"))) == [("1", '5" pipe'), ("2", 'a "b" c'), ("3", "whole"), ("4", ' "x')]
    plan = readers.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])._jdf.queryExecution().toString()
    assert "Window" not in plan  # no line leaves a cell open, so nothing is put in order


def test_headers_that_differ(spark, tmp_path):
    written(tmp_path / "a.csv", [["Cod", "Precio", "Nombre"], ["1", "5", 'a "x"'], ["2", "6", "b\nc"]])
    written(tmp_path / "b.csv", [["Nombre", "Cod"], ["d", "3"]])
    written(tmp_path / "c.csv", [["﻿Cod", "Precio", "Nombre"], ["4", "7", "e"]])
    read = readers.read_csv(spark, str(tmp_path)).select("Cod", "Nombre", "Precio")
    assert cells(read) == [("1", 'a "x"', "5"), ("2", "b\nc", "6"), ("3", "d", ""), ("4", "e", "7")]
    (tmp_path / "one").mkdir()
    written(tmp_path / "one" / "a.csv", [["a", "", "a"], ["1", "2", "3"]])
    assert readers.read_csv(spark, str(tmp_path / "one")).columns == ["a0", "column1", "a2"]


def test_first_block_with_breaks_in_cells(spark, tmp_path):
    rows = [["Estimates\n2024", "", ""], ["", "", ""], ["Empresa", "Fecha", "Bs"], ["Al\n,\npha", "2024-01-01", "1"], ["beta", "2024-01-03", '3"']]
    written(tmp_path / "a.csv", [*rows, ["", "", ""], ["Empresa", "Fecha", "Bs"], ["Gamma", "2024-02-01", "9"]])
    got = readers.read_first_block(spark, str(tmp_path / "a.csv"), ["Empresa", "Fecha", "Bs"], "Fecha", "x")
    assert cells(got) == [("Al\n,\npha", "2024-01-01", "1", "x"), ("beta", "2024-01-03", '3"', "x")]


def test_export_doubles_quotes(spark, tmp_path):
    report = spark.createDataFrame([(1, '12" plate, large'), (2, "two\nlines"), (3, None)], "id int, text string")
    sinks.export_csv(report.coalesce(1), str(tmp_path / "out"))
    [file] = (tmp_path / "out").glob("*.csv")
    assert list(csv.reader(io.StringIO(file.read_text(), newline=""))) == [["id", "text"], ["1", '12" plate, large'], ["2", "two\nlines"], ["3", ""]]
    assert cells(readers.read_csv(spark, str(tmp_path / "out"))) == [("1", '12" plate, large'), ("2", "two\nlines"), ("3", "")]
