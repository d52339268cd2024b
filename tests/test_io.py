"""A1-A8 contracts: discovery, ordered CSV read, CRLF submission, strict validation, JSONL."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import io


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


def test_discovery_prefers_dataset_csv(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{root}/other.csv", "id,query\nwrong,no\n")
    _write(f"{root}/dataset.csv", "id,question\nb,second\na,first\n")
    path = io.discover_csv(spark, root)
    assert path.endswith("/dataset.csv")
    rows = io.read_requests(spark, path).orderBy("original_index").collect()
    assert [r.query for r in rows] == ["second", "first"] and [r.original_index for r in rows] == [0, 1]


def test_read_requests_quotes_bom_and_blank_id(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{root}/in.csv", "﻿ID , Question\n1,\"multi\nline\"\n2,\"say \"\"hi\"\"\"\n3,  padded  \n4,\n")
    rows = io.read_requests(spark, f"{root}/in.csv").orderBy("original_index").collect()
    assert [r.query for r in rows] == ["multi\nline", 'say "hi"', "padded", ""]
    _write(f"{root}/bad.csv", "id,question\n1,a\n ,b\n")
    with pytest.raises(io.ContractError, match="row 3"):
        io.read_requests(spark, f"{root}/bad.csv")


def test_submission_round_trip_250(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{root}/dataset.csv", "id,question\n" + "".join(f"q{i:03d},question {i}\n" for i in range(250)))
    req = io.read_requests(spark, f"{root}/dataset.csv")
    sub = req.select("original_index", "id", F.concat(F.lit("answer, "), "query").alias("response"))
    assert io.write_submission(sub, f"{root}/out", expected=250, single_file=True) == 250
    part = [f for f in os.listdir(f"{root}/out") if f.endswith(".csv")][0]
    raw = open(f"{root}/out/{part}", "rb").read()
    assert raw.startswith(b"id,response\r\nq000,\"answer, question 0\"\r\n")
    back, header = io.read_submission(spark, f"{root}/out/{part}")
    assert io.validate_submission(req, back, header) == 250
    first, last = back.orderBy("original_index").first(), back.orderBy(F.desc("original_index")).first()
    assert (first.id, last.id) == ("q000", "q249")


def test_reordered_ids_rejected(spark):
    req = spark.createDataFrame([(0, "b", "x"), (1, "a", "y")], "original_index long, id string, query string")
    sub = spark.createDataFrame([(0, "a", "one"), (1, "b", "two")], "original_index long, id string, response string")
    with pytest.raises(io.ContractError, match="ids/order"):
        io.validate_submission(req, sub, ["id", "response"])
    with pytest.raises(io.ContractError, match="header"):
        io.validate_submission(req, sub, ["response", "id"])


def test_assessments_last_row_wins(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{root}/a.jsonl", '{"id": "1", "label": "safe", "harmful_probability": 0.1}\n\n'
                              '{"id": "2", "label": "harmful", "harmful_probability": 0.9}\n'
                              '{"id": "1", "label": "HARMFUL", "harmful_probability": 0.8}\n')
    a = io.read_assessments(spark, f"{root}/a.jsonl")
    req = spark.createDataFrame([("1",), ("2",)], "id string")
    got = {r.id: r.label for r in io.join_assessments_by_id(req, a).collect()}
    assert got == {"1": "harmful", "2": "harmful"}
    with pytest.raises(io.ContractError, match="missing 1"):
        io.join_assessments_by_id(spark.createDataFrame([("1",), ("3",)], "id string"), a)


def test_run_status(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    assert io.write_run_status(spark, {"status": "ok", "records": 3}, f"{root}/status")


def test_discovery_any_case_suffix_and_header_check(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{root}/a/notes.CSV", "name,value\nx,1\n")
    _write(f"{root}/b/Queries.Csv", "ID,Query\nq1,hello\n")
    path = io.discover_csv(spark, root)
    assert path.endswith("/b/Queries.Csv")
    rows = io.read_requests(spark, path).collect()
    assert [(r.id, r.query) for r in rows] == [("q1", "hello")]
    empty = tempfile.mkdtemp(prefix="vellum-io-")
    _write(f"{empty}/x.csv", "a,b\n1,2\n")
    with pytest.raises(io.ContractError):
        io.discover_csv(spark, empty)


def test_parts_are_read_in_file_order(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    sizes, at = (2, 900, 40), 0
    for i, n in enumerate(sizes):
        _write(f"{root}/in/part-{i}.csv", "id,question\n" + "".join(f"q{at + j},{'x' * (5 if i != 1 else 50)}\n" for j in range(n)))
        at += n
    rows = io.read_requests(spark, f"{root}/in").orderBy("original_index").collect()
    assert [(r.original_index, r.id) for r in rows] == [(i, f"q{i}") for i in range(sum(sizes))]
    req = io.read_requests(spark, f"{root}/in")
    io.write_submission(req.select("original_index", "id", F.lit("ok").alias("response")), f"{root}/out")
    back, header = io.read_submission(spark, f"{root}/out")
    assert io.validate_submission(req, back, header) == sum(sizes)


def test_undecodable_and_empty_files(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    with open(f"{root}/a.csv", "wb") as fh:
        fh.write(b"id,question\xff\n1,x\n")
    _write(f"{root}/b.csv", "id,query\n1,x\n")
    assert io.discover_csv(spark, root).endswith("/b.csv")
    for text in ("", "id,question\n"):
        _write(f"{root}/c/e.csv", text)
        with pytest.raises(io.ContractError):
            io.read_requests(spark, f"{root}/c/e.csv")
    _write(f"{root}/d/p.csv", "id,response\n")
    with pytest.raises(io.ContractError, match="no rows"):
        io.read_pair_table(spark, f"{root}/d/p.csv", "response")
    _write(f"{root}/d/p.csv", "id,response\n7,x\n")
    assert [tuple(r) for r in io.read_pair_table(spark, f"{root}/d/p.csv", "response").collect()] == [(0, "7", "x")]


def test_broken_assessments_fail(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    for line, why in (('{"id": "1", "label": ', "FAILFAST|malformed|MALFORMED"), ('{"label": "safe"}', "has no id")):
        _write(f"{root}/a.jsonl", '{"id": "0", "label": "safe"}\n' + line + "\n")
        with pytest.raises(Exception, match=why):
            io.read_assessments(spark, f"{root}/a.jsonl").collect()


def test_failed_overwrite_keeps_the_old_output(spark):
    root = tempfile.mkdtemp(prefix="vellum-io-")
    df = spark.createDataFrame([(0, "a", "one")], "original_index long, id string, response string")
    io.write_submission(df, f"{root}/out")
    bad = df.withColumn("response", F.when(F.rand() > 2, "x").otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception):
        io.write_submission(bad, f"{root}/out")
    assert io.read_submission(spark, f"{root}/out")[0].count() == 1
    with pytest.raises(io.ContractError, match="row 2, id a"):
        io.validate_submission(df, df.withColumn("response", F.lit(" ")), ["id", "response"])


@pytest.mark.parametrize("cut", ["before", "away", "moved"])
def test_a_swap_that_is_cut_off_is_mended(spark, tmp_path, monkeypatch, cut):
    """The job dies before, between and after the renames: a reader finds the old or the new output, whole."""
    df = spark.createDataFrame([(0, "a", "old"), (1, "b", "old")], "original_index long, id string, response string")
    path = f"{tmp_path}/out"
    io.write_submission(df, path)
    with monkeypatch.context() as m:
        def dying(s, p):
            fs, at = io._files(s, p)
            if cut != "before":
                fs.rename(at(p), at(f"{p}.old"))
            if cut == "moved":
                fs.rename(at(f"{p}.new"), at(p))
            raise KeyboardInterrupt
        m.setattr(io, "_swap", dying)
        with pytest.raises(KeyboardInterrupt):
            io.write_submission(df.withColumn("response", F.lit("new")), path, expected=2)
    found = {r.response for r in io.read_submission(spark, path)[0].collect()}
    assert found == ({"old"} if cut == "before" else {"new"})
    assert not (tmp_path / "out.old").exists()
    io.write_submission(df.withColumn("response", F.lit("last")), path, expected=2)
    assert {r.response for r in io.read_submission(spark, path)[0].collect()} == {"last"} and not (tmp_path / "out.new").exists()


def test_sink_computes_its_input_once_and_in_order(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            asked.add(len(pdf))
            yield pdf
    rows = spark.range(5000).selectExpr("id as original_index", "concat('q', id) as id", "concat('answer ', id) as response").repartition(7)
    schema = "original_index long, id string, response string"
    assert io.write_submission(rows.mapInPandas(seen, schema), f"{tmp_path}/out", expected=5000, files=6) == 5000
    assert asked.value == 5000
    back, header = io.read_submission(spark, f"{tmp_path}/out")
    assert io.validate_submission(rows, back, header) == 5000
    assert back.where("id <> concat('q', original_index)").count() == 0
    for bad in (rows.where("original_index <> 7").unionByName(rows.where("original_index = 9")), rows.withColumn("original_index", F.col("original_index") + 1)):
        with pytest.raises(io.ContractError, match="not numbered 0 to 4999"):
            io.write_submission(bad, f"{tmp_path}/out", expected=5000)
    with pytest.raises(io.ContractError, match="has 5000 rows, expected 4999"):
        io.write_submission(rows, f"{tmp_path}/out", expected=4999)


def test_validation_joins_only_what_differs(spark, capsys):
    n, block = 4000, 256
    req = spark.range(n).selectExpr("id as original_index", "concat('q', id) as id")
    sub = req.withColumn("response", F.lit("fine"))

    def report(s):
        return tuple(io.validation_report(req, s, block).first())
    assert report(sub) == (n, n, 0, 0, 0, 0) and io.first_violation(req, sub, block).count() == 0
    odd = sub.where("original_index not in (70, 3999)").withColumn("id", F.when(F.col("original_index") == 900, "other").otherwise(F.col("id")))
    odd = odd.withColumn("response", F.when(F.col("original_index") == 2000, " ").otherwise(F.col("response")))
    assert report(odd) == (n, n - 2, 2, 0, 1, 1)
    assert tuple(io.first_violation(req, odd, block).first()) == (70, "missing", "q70")
    more = sub.unionByName(spark.createDataFrame([(n + 5000, "x", "y")], "original_index long, id string, response string"))
    assert report(more) == (n, n + 1, 0, 1, 0, 0) and io.first_violation(req, more, block).first().what == "extra"
    assert report(sub.limit(0)) == (n, 0, n, 0, 0, 0)
    io.validation_report(req, sub, block).explain("formatted")
    plan = capsys.readouterr().out
    assert not any("response" in x for x in plan.splitlines() if "Arguments: hashpartitioning" in x or x.startswith("Output") and "Exchange" in x)


def test_first_violation_is_named(spark):
    req = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "original_index long, id string")
    sub = spark.createDataFrame([(0, "a", "x"), (1, "q", "x"), (2, "c", "x")], "original_index long, id string, response string")
    with pytest.raises(io.ContractError, match="do not match input; first at row 3, id b: id_mismatch"):
        io.validate_submission(req, sub)
    with pytest.raises(io.ContractError, match="count 2 != input count 3; first at row 4, id c: missing"):
        io.validate_submission(req, sub.where("original_index < 2").withColumn("id", F.when(F.col("original_index") == 1, "b").otherwise(F.col("id"))))


def test_files_without_quoted_line_breaks_are_split(spark, tmp_path):
    plain = "id,question\r\n" + "".join(f'q{i},"say ""{i}"", please"\r\n' for i in range(3000))
    (tmp_path / "a.csv").write_text(plain, newline="")
    (tmp_path / "b.csv").write_text(plain + 'last,"two\nlines"\r\n', newline="")
    (tmp_path / "c.csv").write_text("id,question\r\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert not io.has_line_breaks_in_quotes(spark, f"{tmp_path}/a.csv") and io.has_line_breaks_in_quotes(spark, f"{tmp_path}/b.csv")
        for name, n in (("a", 3000), ("b", 3001)):
            rows = io.read_requests(spark, f"{tmp_path}/{name}.csv").orderBy("original_index").collect()
            assert [r.original_index for r in rows] == list(range(n)) and rows[17].id == "q17" and rows[17].query == 'say "17", please'
            assert rows[-1].query == ("two\nlines" if name == "b" else 'say "2999", please')
        split = spark.read.options(**io.CSV_OPTIONS | {"multiLine": "false"}).csv(f"{tmp_path}/a.csv")
        assert split.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(io.ContractError, match="no rows"):
        io.read_requests(spark, f"{tmp_path}/c.csv")
