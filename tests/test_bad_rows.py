import csv
import io
import random
import re

import pytest

from massloom.operators import bad_rows as module
from massloom.operators.bad_rows import bad_rows, good_rows

ROWS = [
    ("a.raw\tWT\t1\t2\t3", None), ("a.RAW\tWT\t+01\t 2 \t3\r", None), ('"a.raw"\t"WT\tx\ny"\t1\t1\t1', None), ('a.d\t"say ""hi"""\t1\t1\t1', None),
    ('a.raw\tW"T\t1\t1\t1', "quoting"), ('"a.raw" \tWT\t1\t1\t1', "quoting"), ('"a.raw\tWT\t1\t1\t1', "quoting"), ('a.raw\t"W""T\t1\t1\t1', "quoting"),
    ("", "column_count"), (None, "column_count"), ("a.raw\tWT\t1\t1", "column_count"), ("a.raw\tWT\t1\t1\t1\t", "column_count"), ('"a.raw\tWT\t1\t1\t1"', "column_count"), ("   \r", "column_count"),
    ("a.txt\tWT\t1\t1\t1", "file_name"), ("d/a.raw\tWT\t1\t1\t1", "file_name"), ("\u00a0\t\u00a0\tx\t1\t1", "file_name"), (".raw.\tWT\t1\t1\t1", "file_name"),
    ("a.raw\t \u00a0\t1\t1\t1", "condition"), ("a.raw\tW\x07T\t1\t1\t1", "condition"), ("a.raw\tW\ufffdT\tx\t1\t1", "condition"), ('a.raw\t""\t1\t1\t1', "condition"),
    ("a.raw\tWT\t0\t1\t1", "biorep"), ("a.raw\tWT\t\uff12\t1\t1", "biorep"), ("a.raw\tWT\t2147483648\tx\t1", "biorep"), ("a.raw\tWT\t\t1\t1", "biorep"),
    ("a.raw\tWT\t2147483647\t1.0\t1", "fraction"), ("a.raw\tWT\t1\t1\t-1", "techrep"), ("a.raw\tWT\t1\t1\t1\u00b2", "techrep"), ("a.raw\tWT\t1\t1\t" + "0" * 5000 + "7", None),
    ("a.raw\tW\x01aT\t1\t1\t1", "condition"), ('"' + 'x""' * 40000 + '"\tWT\t1\t1\t1', "file_name"),
]


@pytest.mark.parametrize("broadcast_chars", [16 << 20, 0])
def test_reasons(spark, monkeypatch, broadcast_chars):
    monkeypatch.setattr(module, "BROADCAST_CHARS", broadcast_chars)
    df = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(ROWS)], "line_id long, raw_line string, reason string, cells string")
    found = {r.line_id: r.reason for r in bad_rows(df, "line_id", "raw_line").collect()}
    assert found == {i: want for i, (_, want) in enumerate(ROWS) if want}
    good = {r.line_id: r for r in good_rows(df, "line_id", "raw_line").collect()}
    assert set(good) == {i for i, (_, want) in enumerate(ROWS) if not want}
    assert good[1].Biorep == 1 and good[1].Fraction == 2 and good[1].FileName == "a.RAW"
    assert good[2].Condition == "WT\tx\ny" and good[3].Condition == 'say "hi"'


def test_empty_table_null_keys_and_repeats(spark):
    empty = spark.createDataFrame([], "line_id long, raw_line string")
    assert bad_rows(empty, "line_id", "raw_line").count() == 0
    assert good_rows(empty, "line_id", "raw_line").count() == 0
    rows = [(None, "bad"), (None, "bad"), (None, "a.raw\tWT\t1\t1\t1"), (1, "a.raw\tWT\t0\t1\t1"), (1, "a.raw\tWT\t0\t1\t1")]
    df = spark.createDataFrame(rows, "line_id long, raw_line string")
    assert sorted(r.reason for r in bad_rows(df, "line_id", "raw_line").collect()) == ["biorep", "biorep", "column_count", "column_count"]
    assert good_rows(df, "line_id", "raw_line").count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_structure_against_a_parser(spark, seed):
    """Random lines of quotes and tabs against a pattern and the csv module."""
    rng = random.Random(seed)
    lines = ["".join(rng.choice('"\ta"') for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    found = {r.line_id: r.reason for r in bad_rows(df, "line_id", "raw_line").collect()}
    cell = '(?:"(?:[^"]|"")*"|[^\t"]*)'
    for i, line in enumerate(lines):
        ok = re.fullmatch(f"{cell}(?:\t{cell})*", line)
        if not ok:
            assert found[i] == "quoting", line
        elif len(next(csv.reader(io.StringIO(line), delimiter="\t"), [""])) != 5:
            assert found[i] == "column_count", line
        else:
            assert found[i] not in ("quoting", "column_count"), line
