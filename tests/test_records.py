"""CSV records with quoted line ends: against Python's csv module, at any split size."""

import csv
import io
import random

import pytest

from mercato.operators import quality
from mercato.sources import records as R
from mercato.sources.csv import read_text_csv

NAMES = ["id", "name", "note"]


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def quoted(text, end):
    return '"' + text.replace('"', '""').replace("\n", end) + '"'


def file_of(rnd, rows, end):
    """Text of a file, and the records with their first lines."""
    out, want, line = ["id,name,note" + end], [], 2
    for i in range(rows):
        if rnd.random() < 0.05:
            out.append(end)  # a blank line
            line += 1
        texts = [rnd.choice(["a b", 'say "hi"', "x,y", "two\nlines", "a\n\n\nb", "", 'end"', '""', "\n", "é ñ", '5" pipe', "tail\n"]) for _ in range(2)]
        fields = [quoted(t, end) if any(c in t for c in '",\n') and t != '5" pipe' or rnd.random() < 0.2 else t for t in texts]
        out.append(f"{i},{fields[0]},{fields[1]}{end}")
        want.append((str(i), *(t.replace("\n", end) or None for t in texts), line, i + 2))
        line += out[-1].count("\n")
    return "".join(out), want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_in_many_splits(spark, small_splits, tmp_path, end):
    rnd = random.Random(3)
    want = []
    for k in range(4):
        text, rows = file_of(rnd, 120, end)
        (tmp_path / f"f{k}.csv").write_text(text, encoding="utf-8", newline="")
        want += [(f"f{k}.csv", *r) for r in rows]
    found = R.read_records(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 10
    fields = R.parse_records(found.withColumn("id", found["file"]), NAMES, numbers=True)
    got = [tuple(r) for r in fields.collect()]
    assert sorted(map(repr, ((*r[:3], r[3], r[4]) for r in got))) == sorted(map(repr, (r[1:] for r in want))) and not any(r[5] for r in got)
    python = [r for k in range(4) for r in list(csv.reader(io.StringIO((tmp_path / f"f{k}.csv").read_bytes().decode(), newline="")))[1:] if r]
    assert sorted((r[0], r[1] or "", r[2] or "") for r in got) == sorted(map(tuple, python))


def test_a_field_over_many_splits_and_an_unclosed_quote(spark, small_splits, tmp_path):
    note = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "long.csv").write_text('id,note\n1,"' + note + '"\n2,x\n')
    got = [tuple(r) for r in R.parse_records(R.read_records(spark, str(tmp_path / "long.csv")), ["id", "note"], True).collect()]
    assert sorted(got) == [("1", note, 2, 2, False), ("2", "x", 302, 3, False)]
    (tmp_path / "open.csv").write_text('id,note\n1,"open\n' + "".join(f"{i},x\n" for i in range(2, 90)))
    got = R.read_records(spark, str(tmp_path / "open.csv"), max_lines=50).collect()
    assert len(got) == 89 and all(r["_unclosed"] for r in got) and sorted(r["_line"] for r in got) == list(range(2, 91))
    one = R.read_records(spark, str(tmp_path / "open.csv")).collect()
    assert len(one) == 1 and one[0]["_unclosed"] and one[0]["record"].endswith("89,x")


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id\n")
    (tmp_path / "c.csv").write_text("﻿id,x\n\n7,8")
    assert [tuple(r) for r in R.parse_records(R.read_records(spark, str(tmp_path)), ["id", "x"], True).collect()] == [("7", "8", 3, 2, False)]
    assert R.read_records(spark, str(tmp_path / "c.csv"), header=False).where("_record = 1").first()["record"] == "id,x"


def test_ends_inside():
    for line, want in (("a,b", (False, False)), ('"a', (True, False)), ('a,"b""', (True, True)), ('5" pipe', (False, False)), ('x"",y', (False, True)),
                       ('"a","b', (True, True)), ('""', (False, True)), ("", (False, True))):
        assert R.ends_inside(line, False) is want[0], line
    assert R.ends_inside("no quote", True) and not R.ends_inside('end"', True) and R.ends_inside('end","on', True) and R.ends_inside('a""b', True)


def test_reader_and_validator_use_them(spark, small_splits, tmp_path):
    path = str(tmp_path / "customers.csv")
    rows = [f'{i},Ana,B,"Ruiz\n{i}",1,"Calle {i}\r\nPiso 2"\n' for i in range(1, 60)]
    rows[40] = "x,Eva,,Paz,1,Calle\n"
    (tmp_path / "customers.csv").write_text("CustomerID,FirstName,MiddleInitial,LastName,CityID,Address\n" + "".join(rows), newline="")
    got = {r["CustomerID"]: r for r in read_text_csv(spark, path).collect()}
    assert len(got) == 59 and got["7"]["Address"] == "Calle 7\r\nPiso 2" and got["7"]["LastName"] == "Ruiz\n7"
    report = quality.validate_file(spark, path, "customers.csv").collect()
    assert [(r["key"], r["column"], r["rule"]) for r in report] == [("x", "CustomerID", "type")] and report[0]["message"].startswith("row 42: ")
    assert quality.load_csv_table(spark, path, "customers", str(tmp_path / "out")) == {"table": "customers", "rows": 59, "rejected": 1}
    (tmp_path / "cities.csv").write_text('CityID,CityName,Zipcode,CountryID\r\n1,"San\r\nJuan",5400,1\r\n2,"open,1,1\r\n')
    report = quality.validate_file(spark, str(tmp_path / "cities.csv"), "cities.csv").collect()
    assert ("2", "malformed_row") in {(r["key"], r["rule"]) for r in report}
