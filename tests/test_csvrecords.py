"""CSV records over many splits against Python's csv module."""

import csv
import io
import random

import pytest

from vigil.sources import logs
from vigil.sources.csvrecords import csv_records, csv_rows

HEADER = ["TimeCreated", "EventID", "Message", "IpAddress", "TargetUserName", "IpPort"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def python_rows(text):
    return [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]


def found(spark, path, width):
    records = csv_records(spark, str(path))
    heads = [r.record for r in records.where("head").collect()]
    rows = csv_rows(records.where("not head"), [f"x{i}" for i in range(width)])
    return heads, sorted(tuple(r)[1:] for r in rows.collect())


def test_fuzzed_tables(small_splits, tmp_path):
    """Well-formed tables with anything inside quotes; stray quotes in unquoted fields."""
    rng = random.Random(5)
    for n in range(6):
        pieces = ["a", "bc", ",", '"', "\n", "\r\n", '""', " ", "é", "", "x" * 30]
        rows = [["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(4)] for _ in range(60)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=rng.choice(("\n", "\r\n")), quoting=rng.choice((csv.QUOTE_MINIMAL, csv.QUOTE_ALL))).writerows([list("wxyz"), *rows])
        text = ("﻿" if n % 2 else "") + out.getvalue()
        if n % 3 == 0:
            text += 'p,q"r,s""t,u"\nplain"quote,"a\n""b""",,\n\n'
        path = tmp_path / f"{n}.csv"
        path.write_bytes(text.encode())
        want = python_rows(text)
        heads, got = found(small_splits, path, 4)
        assert python_rows(heads[0]) == want[:1] and len(heads) == 1
        assert got == sorted(map(tuple, want[1:])), n


def test_many_files_and_unclosed_quotes(small_splits, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text('h1,h2\n3,ok\n4,"never closed\n5,lost\n' * 1)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    heads, got = found(small_splits, tmp_path, 2)
    assert heads == ["h1,h2", "h1,h2"] and got == [("1", "x\ny"), ("2", "z"), ("3", "ok")]
    (tmp_path / "b.csv").write_text('h1,h2\n3,ok\n4,"' + "long\n" * 100 + '"\n5,after\n')
    monkeypatch.setattr("vigil.sources.csvrecords.MAX_RECORD_CHARS", 400)
    assert found(small_splits, tmp_path, 2)[1] == [("1", "x\ny"), ("2", "z"), ("3", "ok"), ("5", "after")]


def test_messages_can_forge_no_events(small_splits, tmp_path):
    """Quoted messages with line breaks, commas and doubled quotes before and after the other columns."""
    rng = random.Random(9)
    messages = ["plain", "two\nlines", "first\n2024-01-01T00:09:00,4625,z,6.6.6.6,evil,1\nlast", 'says ""x"", and "more"', "a,b,c", "ends with quote\"", '"\n"', "\r\n", ""]
    rows = [[f"2024-01-01T00:{i % 60:02d}:00", rng.choice(("4625", "4624")), rng.choice(messages), f"10.0.0.{i % 200}", rng.choice(('CORP\\bob "x", y', "ann", "o'neil", "back\\")), str(i)] for i in range(120)]
    for name, order in (("first", [0, 1, 2, 3, 4, 5]), ("last", [5, 4, 3, 1, 0, 2])):
        out = io.StringIO(newline="")
        csv.writer(out).writerows([[r[i] for i in order] for r in [HEADER, *rows]])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    got = sorted((r.event_type, r.source_ip, r.username, r.port) for r in logs.read_windows(small_splits, str(tmp_path)).collect())
    assert got == sorted(({"4625": "failed_login", "4624": "successful_login"}[r[1]], r[3], r[4], int(r[5])) for r in rows * 2)


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"x\ny"\n2,z\n')
    plan = csv_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("from_out" in line and "value" in line for line in windows) and "windowspecdefinition(source_file#" in plan
    assert not any("split#" in line.split("], [")[1] for line in windows)  # no window over the lines of a split
