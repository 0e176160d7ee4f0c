"""Records with line breaks inside quoted fields, at every block size, against Python's csv reader."""

import csv
import io
import os
import random
import tempfile

import pytest

from flowlens.session import materialize
from flowlens.sources import flows_io as IO
from flowlens.sources import quoted_csv as Q


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_scanner_both_dialects():
    for escape in ('\\', '"'):
        scan = Q.LineScanner(escape)
        assert not scan("a,b", False) and scan("a,b", True)
        assert scan('1,"two', False) and not scan('lines"', True) and not scan('lines",x', True)
        assert scan('lines","again', True) and not scan('5" pipe,6', False) and not scan("", False) and scan("", True)
        assert not scan('"a"b"c,d', False) and scan('"a"b"c,"d', False) and scan('x","', False)
    assert Q.LineScanner()(r'"say \"hi', False) and not Q.LineScanner()(r'"say \"hi"', False) and Q.LineScanner()('"x\\', False)
    assert Q.LineScanner('"')('"say ""hi', False) and Q.LineScanner('"')('"a""', False) and not Q.LineScanner('"')('"a"""', False)
    assert Q.LineScanner('"')("," * 100_000 + '"' + "x" * 100_000, False)


@pytest.mark.parametrize("block", [24, 1 << 20])
@pytest.mark.parametrize("few", [True, False])
def test_records_at_any_block_size(spark, monkeypatch, block, few):
    rng, root = random.Random(block), tempfile.mkdtemp(prefix="flowlens-quoted-")
    want = {}
    for n in range(2):
        rows = [["x", "y,z", "w\nv"]] + [[rng.choice(["", "a", "b\nc", "\n\n", 'q"r', ",", "long " * 9, "1\n2\n3"]) + str(i)
                                          for _ in range(3)] for i in range(12)]
        buf = io.StringIO()
        csv.writer(buf, lineterminator="\n").writerows(rows)
        _write(f"{root}/f{n}.csv", buf.getvalue())
        want[f"f{n}.csv"] = rows
    if not few:
        monkeypatch.setattr(Q, "MAX_BROADCAST", 0)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        lines = Q.lines_of(spark, root)
        starts = materialize(Q.survey(lines, '"'), "t")
        got = Q.records(lines, starts.where("broken and not unclosed"), lambda d: materialize(d, "t"), '"').collect()
        blocks = starts.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 10 or block > 24
    for name, rows in want.items():
        mine = [r for r in got if r.file.endswith(name)]
        assert sorted(next(csv.reader(io.StringIO(r.text))) for r in mine) == sorted(rows)
        assert [next(csv.reader(io.StringIO(r.text))) for r in mine if r.first] == [rows[0]]


def test_ingest_keeps_records_with_line_breaks(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ingest-")
    _write(f"{root}/a/broken.csv", 'x,y\n1,"two\nlines"\n\n2,b\n')
    _write(f"{root}/a/plain.csv", 'x,y\n3,"q,r"\n')
    _write(f"{root}/a/unclosed.csv", 'x,y\n4,b\n5,"never\nclosed\n')
    _write(f"{root}/b/other.csv", 'y,"x",Label\n"l\n1",6,"z\nz"\n')
    _write(f"{root}/b/long.csv", 'x,y\n7,"a\nb",c\n8,d\n')
    rows, bad = IO.ingest_labelled_folders(spark, root, ["a", "b"])
    assert sorted((r.x, r.y, r.label) for r in rows.collect()) == [
        (1, "two\nlines", "a"), (2, "b", "a"), (3, "q,r", "a"), (6, "l\n1", "b")]
    assert sorted((os.path.basename(r.file), r.folder, r.n_rows) for r in bad.collect()) == [
        ("long.csv", "b", 2), ("unclosed.csv", "a", 3)]


def test_ingest_doubled_quotes(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ingest-")
    _write(f"{root}/a/f.csv", 'x,y\n1,"say ""hi""\nthere"\n')
    _write(f"{root}/a/g.csv", 'x,y\n2,"say ""hi"""\n')
    rows, bad = IO.ingest_labelled_folders(spark, root, ["a"], escape='"')
    assert sorted((r.x, r.y) for r in rows.collect()) == [(1, 'say "hi"\nthere'), (2, 'say "hi"')] and bad.count() == 0


def test_ingest_refuses_folders_without_a_sound_file(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ingest-")
    _write(f"{root}/a/f.csv", 'x,"y\n1,2\n')
    with pytest.raises(ValueError, match="quoted field"):
        IO.ingest_labelled_folders(spark, root, ["a"])
