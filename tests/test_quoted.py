"""Quoted line breaks: reading in many pieces equals one sequential parse."""

import csv
import io
import random

import numpy as np
import pytest

from tripgrid.config import NULL_TOKENS, ColumnMap
from tripgrid.sources import quoted, readers

HEADER = ["trip_id", "note", "more"]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([HEADER, *rows])
    path.write_bytes(out.getvalue().encode())


def note(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "xyz", "b" * 90]) for _ in range(rng.randrange(1, 12)))


def plain(rows):
    """As null tokens are read."""
    return [tuple(None if v in NULL_TOKENS else v for v in r) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_blocks_equal_one_sequential_parse(spark, tmp_path, small_blocks, end):
    rng = random.Random(4)
    want = []
    for k in range(3):
        # Every other file has no line break at all.
        rows = [[f"{k}-{i}", note(rng) if k != 1 else "plain", rng.choice(["", "x", 'say "y"'])] for i in range(60)]
        written(tmp_path / f"f{k}.csv", rows, end)
        want += plain(rows)
    assert quoted.has_line_breaks(spark, [str(tmp_path)])
    read = readers.read_text_tables(spark, str(tmp_path / "*.csv"))
    found = [tuple(r[c] for c in HEADER) for r in read.orderBy("file_ord", "row_ord").collect()]
    assert found == want
    blocks = quoted.records(spark, [str(tmp_path / "f0.csv")]).select("block").distinct().count()
    assert blocks > 10


def test_scan_trips_with_line_breaks(spark, tmp_path, small_blocks):
    c = ColumnMap()
    names = [c.start_time, c.end_time, c.distance, *c.lats, *c.lons, "note"]
    head = ",".join(names) + "\n"
    row = 't0,t1,5,1,2,3,4,"two\nlines, ""quoted"""\n'
    (tmp_path / "a.csv").write_text(head + row * 30)
    (tmp_path / "b.csv").write_text(head + row.replace("two\nlines", "one line") * 3)
    rows = readers.scan_trips(spark, str(tmp_path), city="x").orderBy("file_ord", "row_ord").collect()
    assert [r["note"] for r in rows] == ['two\nlines, "quoted"'] * 30 + ['one line, "quoted"'] * 3
    assert {r[c.distance] for r in rows} == {"5"} and len(rows) == 33
    (tmp_path / "c.csv").write_text("other" + head + row)
    with pytest.raises(ValueError, match="different headers"):
        readers.scan_trips(spark, str(tmp_path))


def test_stray_quotes_and_line_ends(spark, tmp_path):
    """A quote inside an unquoted field opens nothing; text after a closing quote stays; CR ends a line."""
    (tmp_path / "a.csv").write_bytes(b'trip_id,note,more\r1,5" pipe,x\r2,"a\rb",y\r\r3,,"open\rto the end')
    read = readers.read_text_tables(spark, str(tmp_path))
    found = [tuple(r[c] for c in HEADER) for r in read.orderBy("row_ord").collect()]
    assert found[:2] == [("1", '5" pipe', "x"), ("2", "a\rb", "y")]
    assert found[2][0] == "3" and len(found) == 3
    (tmp_path / "a.csv").write_text('trip_id,note,more\n1,5" pipe,x\n2,"it is 6"",",y\n')
    assert not quoted.has_line_breaks(spark, [str(tmp_path)])


def test_no_line_breaks_take_the_plain_reader(spark, tmp_path, monkeypatch):
    written(tmp_path / "a.csv", [["1", 'x, "y"', ""]])
    monkeypatch.setattr(quoted, "records", None)
    assert readers.read_text_tables(spark, str(tmp_path)).first()["note"] == 'x, "y"'


def test_effects_chain():
    rng = np.random.default_rng(1)
    for _ in range(200):
        effect = rng.integers(0, 4, rng.integers(1, 9))
        for before in (False, True):
            state, want = before, []
            for e in effect:
                state = {quoted.SAME: state, quoted.SWAP: not state, quoted.OUTSIDE: False, quoted.INSIDE: True}[int(e)]
                want.append(state)
            assert quoted.inside_after(effect, before).tolist() == want


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trip_id,note,more\n")
    (tmp_path / "b.csv").write_text('trip_id,note,more\n7,"\n\n",z\n')
    read = readers.read_text_tables(spark, str(tmp_path)).collect()
    assert [(r["trip_id"], r["more"]) for r in read] == [("7", "z")]
