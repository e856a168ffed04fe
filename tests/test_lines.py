"""Files as a source that knows its lines, the encoder table function, and charged responses."""

import gzip
import json

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators.exposure import budgeted_query_select
from winnow.operators.ledger import ResponseLedger
from winnow.sources import encoder, lines, readers
from winnow.streaming.ops import run_available

ROW = "id string, n bigint, x double, tags array<string>"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_files_and_bad_lines(spark, tmp_path):
    good = [{"id": f"r{i}", "n": i, "x": i / 2, "tags": ["a", "b"][: i % 3]} for i in range(50)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(g) + "\n" for g in good[:30]) + "\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("".join(json.dumps(g) + "\n" for g in good[30:]))
    (tmp_path / "_SUCCESS").write_text("not data")
    df = lines.read_lines(spark, str(tmp_path), ROW)
    assert rows_of(df) == sorted(((g["id"], g["n"], g["x"], g["tags"]) for g in good), key=str)
    (tmp_path / "c.jsonl").write_text('{"id": "ok"}\n\n{"id": 5}\nnot json\n[1]\n{"id": "x", "n": "7"}\n{"id": "y", "tags": ["a", 1]}\n')
    bad = rows_of(lines.bad_lines(spark, str(tmp_path), ROW))
    assert [(r[0].rsplit("/", 1)[1], r[1]) for r in bad] == [("c.jsonl", n) for n in (3, 4, 5, 6, 7)]
    assert "id is int, not string" in bad[0][2] and "an object" in bad[2][2]
    with pytest.raises(PythonException, match=r"c\.jsonl:3: id is int"):
        lines.read_lines(spark, str(tmp_path), ROW).collect()
    assert lines.read_lines(spark, str(tmp_path / "nothing-*"), ROW).collect() == []


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_ranges_of_a_file_hold_every_line_once(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(lines, "RANGE_BYTES", size)
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps({"id": f"é{i}" * (i % 4), "n": i}) + "\n" for i in range(40)) + '{"id": 1}\n{"id": "last", "n": 40}')
    pieces = lines.planned([str(path)], "json")
    found = [r for p in pieces for r in lines.parsed(p, "json", lines.StructType.fromDDL("id string, n bigint"))]
    assert [r[2][1] for r in found if r[2]] == list(range(41)) and sum(r[2] is None for r in found) == 1
    bad = next(r for r in found if r[2] is None)
    assert lines.lines_before(str(path), bad[0]) + 1 == 41


def test_csv_with_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,id,x\n1,"two\nlines",0.5\n2,"quoted ""word""",\n\n3,short\nfour,b,1\n5,c,2\n')
    df = lines.read_lines(spark, str(tmp_path), "id string, n bigint, x double", "csv", "report")
    assert rows_of(df.filter("_error is null").select("id", "n", "x")) == [("c", 5, 2.0), ('quoted "word"', 2, None), ("two\nlines", 1, 0.5)]
    assert [r[1] for r in rows_of(lines.bad_lines(spark, str(tmp_path), "id string, n bigint, x double", "csv"))] == [6, 7]
    with pytest.raises(PythonException, match=r"a\.csv:1: no column y"):
        lines.read_lines(spark, str(tmp_path), "y string", "csv").collect()


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": ["a", "b", None][i % 3], "n": i, "x": float(i)}) + "\n" for i in range(30)))
    schema = "id string, n bigint, x double"
    full = lines.read_lines(spark, str(tmp_path), schema)
    for rule in ("id = 'a' and n >= 6", "id is null", "id is not null and n in (1, 2, 3)", "x > 20", "id <=> 'b'", "n < 4 or n > 27", "n > 5 and x < 9.0", "id <> 'a' and n > 3", "not (n in (1, 2))"):
        assert rows_of(lines.read_where(spark, str(tmp_path), schema, rule)) == rows_of(full.filter(rule)), rule
    spark.conf.set(lines.PUSHED, "true")
    try:
        df = spark.read.format("winnow_lines").schema(schema).option("push", "true").load(str(tmp_path))
        plan = df.filter("id = 'a' and n >= 6")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(lines.PUSHED, "false")
    assert "Filter (" not in plan  # nothing is left for Spark to do


def test_stream_reads_each_file_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    lines.register(spark)
    stream = lambda: spark.readStream.format("winnow_lines").schema("n bigint").load(folder)
    for name, values in (("b", (1, 2)), ("a", (3,))):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(f'{{"n": {v}}}\n' for v in values))
        run_available(stream(), out, state)
    assert rows_of(spark.read.parquet(out)) == [(1,), (2,), (3,)]


def test_readers_name_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user_id": "u", "parent_asin": "i", "timestamp": 5, "rating": 4.0}\n{"user_id": \n')
    with pytest.raises(ValueError, match=r"a\.jsonl:2: malformed line"):
        readers.read_reviews(spark, str(tmp_path), "books")


TURNS = "conv_id bigint, turn bigint, prompt string, response string"


def test_encoder_yields_none_one_or_many(spark):
    rows = spark.createDataFrame([(1, 0, "a b", "c"), (1, 1, "d", None), (2, 0, "", "e f g"), (3, 0, None, "x")], TURNS)
    got = {r["record_id"]: r for r in encoder.encode(rows, "winnow.sources.encoder:words").collect()}
    assert got.keys() == {"1:0", "2:0"}
    assert got["1:0"]["labels"][:2] == [schemas.MASKED] * 2 and len(got["2:0"]["input_ids"]) == 4
    assert got["1:0"]["domain"] == "opening"


def test_encoder_names_are_checked_before_tasks_run(spark):
    rows = spark.createDataFrame([(1, 0, "a", "b")], TURNS)
    for name in ("words", "winnow.sources.encoder:nothing", "no.such.module:f"):
        with pytest.raises(AnalysisException):
            encoder.encode(rows, name)
    encoder.register(spark)
    with pytest.raises(AnalysisException, match="is a table"):
        spark.sql("select * from encode_records(1, 'winnow.sources.encoder:words')")


def test_broken_records_are_refused(spark):
    twice = spark.createDataFrame([(1, 0, "a", "b"), (1, 0, "c", "d")], TURNS)
    with pytest.raises(ValueError, match="duplicate_record_id"):
        encoder.encode(twice, "winnow.sources.encoder:words")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def test_responses_are_charged_once(spark, tmp_path):
    responses = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id bigint, a array<double>")
    ledger = ResponseLedger(spark, str(tmp_path / "ledger"), 4)
    assert ledger.charged().count() == 0
    assert rows_of(ledger.responses(ids(spark, 1, 2), responses, "one")) == [(1, [1.0, 1.0]), (2, [2.0, 1.0])]
    assert rows_of(ledger.responses(ids(spark, 2, 1), responses, "again")) == [(1, [1.0, 1.0]), (2, [2.0, 1.0])]
    assert ledger.responses(ids(spark, 2, 3), responses, "two").count() == 2
    assert rows_of(ledger.charged()) == [(1, "one"), (2, "one"), (3, "two")]
    for bad, why in ((ids(spark, 4, 5), "over_budget"), (ids(spark, 4, 4), "duplicate"), (ids(spark, 4, 99), "unknown")):
        with pytest.raises(ValueError, match=why):
            ledger.responses(bad, responses)
    assert rows_of(ResponseLedger(spark, str(tmp_path / "ledger"), 4).charged()) == [(1, "one"), (2, "one"), (3, "two")]
    with pytest.raises(ValueError, match="at least 1"):
        ResponseLedger(spark, "x", 0)


def test_selection_reads_responses_through_the_ledger(spark, tmp_path):
    """Nothing but the nominated rows is charged, and a ledger without room refuses the selection."""
    df = spark.createDataFrame([(i, [float(i % 5), float(i)]) for i in range(30)], "id bigint, v array<double>")
    responses = spark.createDataFrame([(i, [float(i % 3), 1.0 - i % 2]) for i in range(30)], "id bigint, a array<double>")
    ledger = ResponseLedger(spark, str(tmp_path / "ledger"), 9)
    _, report = budgeted_query_select(df, responses, 6, "random_frontier", 2, 1, 2, seed=1, ledger=ledger)
    assert {r["id"] for r in ledger.charged().collect()} == set(report["ids"]) and report["charged"] == 6
    with pytest.raises(ValueError, match="over_budget"):
        budgeted_query_select(df, responses, 6, "random_frontier", 2, 1, 2, seed=2, ledger=ledger)
    assert ledger.charged().count() == 6
    assert responses.join(ledger.charged(), "id", "left_semi").agg(F.count("*")).first()[0] == 6
