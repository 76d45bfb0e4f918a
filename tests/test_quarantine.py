import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costweave.sources import quarantine, tables

LINES = '''A,B,B
1,x,"a, b"
2,"he said ""no""",N/A
3,too few
4,too,many,cells

5,"open,2
6,stray"quote,x
7,"",
'''


def test_every_record_is_in_one_table(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(LINES)
    good, bad = quarantine.read_checked(spark, str(tmp_path / "raw.csv"))
    assert good.columns == ["A", "B", "B.1"]
    assert [tuple(r) for r in good.collect()] == [("1", "x", "a, b"), ("2", 'he said "no"', None), ("7", None, None)]
    told = {r["record"]: (r["n_cells"], r["reason"]) for r in bad.collect()}
    assert told == {
        "3,too few": (2, quarantine.TOO_FEW), "4,too,many,cells": (4, quarantine.TOO_MANY), "": (None, quarantine.EMPTY),
        '5,"open,2': (None, quarantine.OPEN_QUOTE), '6,stray"quote,x': (None, quarantine.OPEN_QUOTE),
    }
    assert {r["file"] for r in bad.collect()} == {"raw.csv"}


def test_files_without_records(spark, tmp_path):
    (tmp_path / "head.csv").write_text("A,B\n")
    (tmp_path / "empty.csv").write_text("")
    for name in ("head.csv", "empty.csv"):
        good, bad = quarantine.read_checked(spark, str(tmp_path / name))
        assert good.count() == bad.count() == 0
    with pytest.raises(FileNotFoundError):
        quarantine.read_checked(spark, str(tmp_path / "none.csv"))


def test_long_cells(spark, tmp_path):
    (tmp_path / "long.csv").write_text('A,B\n1,"' + "x, " * 200_000 + '"\n' + "1," * 20_000 + "\n")
    good, bad = quarantine.read_checked(spark, str(tmp_path / "long.csv"))
    assert good.select(F.length("B")).first()[0] == 600_000
    assert bad.select("n_cells").first()[0] == 20_001


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab," ', max_size=6), min_size=2, max_size=5), min_size=1, max_size=8))
def test_cells_equal_those_of_a_csv_parser(spark, rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    lines = out.getvalue().splitlines()
    table = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = table.orderBy("k").select(quarantine.split_record(F.col("line"))).collect()
    assert [r[0] for r in got] == rows


def test_line_breaks_inside_cells(spark, tmp_path):
    (tmp_path / "note.csv").write_text('"A (a\nnote)",B\n1,"x\ny"\n2,z\n')
    rows = tables.read_raw(spark, str(tmp_path / "note.csv"), line_breaks=True)
    assert rows.columns == ["A (a\nnote)", "B"] and [tuple(r) for r in rows.collect()] == [("1", "x\ny"), ("2", "z")]
