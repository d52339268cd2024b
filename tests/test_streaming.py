"""Row-local tagging runs unchanged on a stream (availableNow trigger, checkpointed)."""

import tempfile

from vellum.operators.normalize import normalize_table
from vellum.operators.tagging import tag_and_route
from vellum.streaming.tagging import route_count_stream, tag_stream

SF = "/root/testdata/sf0.001"


def test_tag_stream_equals_batch(spark, pack):
    out, ck = tempfile.mkdtemp(prefix="vellum-st-"), tempfile.mkdtemp(prefix="vellum-ck-")
    q = tag_stream(spark, SF, out, ck, "doc_id long, text string, lang string, source string, n_chars long",
                   "text", pack, ["doc_id"], path_glob="documents.parquet")
    q.awaitTermination(300)
    streamed = {r.doc_id: r.route_name for r in spark.read.parquet(out).collect()}
    batch = tag_and_route(normalize_table(spark.read.parquet(f"{SF}/documents.parquet"), "text", max_chars=None),
                          "text_norm", pack, "text_compact")
    want = {r.doc_id: r.route_name for r in batch.select("doc_id", "route_name").collect()}
    assert streamed == want


def test_route_count_stream(spark, pack):
    out, ck = tempfile.mkdtemp(prefix="vellum-st-"), tempfile.mkdtemp(prefix="vellum-ck-")
    q = route_count_stream(spark, SF, out, ck, "doc_id long, text string, lang string, source string, n_chars long",
                           "text", pack, path_glob="documents.parquet")
    q.awaitTermination(300)
    total = sum(r.n for r in spark.read.parquet(out).collect())
    assert total == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_last_assessment_of_a_stream_survives_a_restart(spark, tmp_path):
    """Files arrive one by one, out of order, with a restart between; the same rows as the batch form."""
    import json

    from vellum.sources import io
    from vellum.streaming.assessments import latest_stream, latest_table, write_latest

    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()

    def put(name, *rows):
        (tmp_path / name).write_text("\n".join(["", *[json.dumps({"id": i, "label": x, "harmful_probability": p}) for i, x, p in rows], ""]))
        (tmp_path / name).rename(source / name)

    def run():
        write_latest(latest_stream(spark, str(source), 1), out, ck).awaitTermination(200)
        return {r.id: (r.label, r.harmful_probability) for r in latest_table(spark, out).collect()}

    put("b.jsonl", ("1", "safe", .1), ("2", "harmful", .9), ("1", "harmful", .8), ("3", "safe", .2))
    assert run() == {"1": ("harmful", .8), "2": ("harmful", .9), "3": ("safe", .2)}
    put("a.jsonl", ("1", "safe", .3), ("4", "unknown", None))  # arrives later, but stands before b
    put("c.jsonl", ("3", "harmful", .7), ("3", "safe", .6))
    got = run()
    assert got == {"1": ("harmful", .8), "2": ("harmful", .9), "3": ("safe", .6), "4": ("unknown", None)}
    batch = io.last_by_id(io.read_assessments(spark, str(source)))
    assert got == {r.id: (r.label, r.harmful_probability) for r in batch.collect()}
    assert run() == got  # nothing new
    put("d.jsonl", (None, "safe", .1))
    import pytest
    with pytest.raises(Exception, match="no id"):
        run()
