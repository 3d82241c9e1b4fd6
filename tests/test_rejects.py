import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgauge.operators.rejects import BENCHMARK_SPEC, PERSON_SPEC, RecordSpec, parse_lines, split_rows

GOOD = "2024HU1,3,71,76,2,1,1,02,3,8030"
DOB = '"June 3, 1971"'
BENCH = f"Ohio,Male,{DOB},White,Single,Doctorate,Employed,Florists,Noncitizen"


def reasons(spark, spec, lines):
    df = spark.createDataFrame([(i, x, "own") for i, x in enumerate(lines)], "line_id int, raw_line string, rec string")
    got = {r["line_id"]: r["errors"] for r in parse_lines(df, spec).collect()}
    return [got[i] for i in range(len(lines))]


@pytest.mark.parametrize(
    "line, ok",
    [
        (GOOD, True), (GOOD + "\r", True), ('"a",1,1.5, 40 ,,,,,,', True), ("a,1,1,120,,,,,,", True), ("a,1,1,121,,,,,,", False), ("a,1,-1,40,,,,,,", False), ("a,1,nan,40,,,,,,", False), ("a,1,1e3,40,,,,,,", False),
        ("a,1,,40,,,,,,", False), (None, False), ("", False), ("   ", False), (GOOD + ",x", False), ('a"b,1,1,40,,,,,,', False), ('"a"b,1,1,40,,,,,,', False), ('"a,1,1,40,,,,,,', False), ('"a""b",1,1,40,,,,,,', True), ('"",1,1,40,,,,,,', True),
        (f"{GOOD}\n{GOOD}", False), ('"a\nb",1,1,40,,,,,,', True), ('"a,b",1,1,40,,,,,,', True), ("\x01,1,1,40,,,,,,", True),
    ],
)
def test_person_lines(spark, line, ok):
    assert (reasons(spark, PERSON_SPEC, [line])[0] == []) is ok


def test_benchmark_lines(spark):
    lines = [BENCH, BENCH.replace("Florists", "unknown"), BENCH.replace("Florists", "12.5"), BENCH.replace("Male", "  "), BENCH.replace("June 3", "June 31"), BENCH.replace(DOB, "1971-06-03"), BENCH.replace("Florists", '"Drivers ""HGV"""')]
    assert [not r for r in reasons(spark, BENCHMARK_SPEC, lines)] == [True, False, False, False, False, False, True]
    assert reasons(spark, BENCHMARK_SPEC, [BENCH.replace("Florists", "")])[0] == ["occupation: blank", "occupation: no letters", "occupation: marker for a missing value"]


def test_split_types_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, GOOD), (1, GOOD), (2, "x")], "line_id int, raw_line string")
    good, bad = split_rows(parse_lines(df, PERSON_SPEC), PERSON_SPEC)
    assert [(r["line_id"], r["AGEP"]) for r in good.collect()] == [(1, 76.0), (1, 76.0)]
    assert [r["errors"] for r in bad.collect()] == [["wrong number of fields: 1"]]
    assert parse_lines(df.limit(0), PERSON_SPEC).count() == 0


def test_long_lines(spark):
    spec = RecordSpec(("a", "b"))
    df = spark.createDataFrame([(1, '"' + 'x"",' * 50_000 + '",z')], "line_id int, raw_line string")
    row = parse_lines(df, spec).first()
    assert row["errors"] == [] and row["rec"]["a"] == 'x",' * 50_000 and row["rec"]["b"] == "z"


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab,"\n é\x01', max_size=6), min_size=2, max_size=2), min_size=200, max_size=200))
def test_round_trip(spark, rows):
    def line(fields):
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
        return out.getvalue()

    df = spark.createDataFrame([(i, line(f)) for i, f in enumerate(rows)], "line_id int, raw_line string")
    got = {r["line_id"]: [r["a"], r["b"]] for r in parse_lines(df, RecordSpec(("a", "b"))).select("line_id", "rec.*").collect()}
    assert [got[i] for i in range(len(rows))] == rows


def test_one_pass_over_the_lines(spark):
    df = spark.createDataFrame([(1, GOOD)], "line_id int, raw_line string")
    plan = split_rows(parse_lines(df, PERSON_SPEC), PERSON_SPEC)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and F is not None
