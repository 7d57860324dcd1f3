"""Work and memory that must not grow faster than the input: what is parsed, read and rendered once, and what streams through."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import queries_records
from quillspark.operators.pseudonyms import _replacing
from quillspark.plans import calibrate, registry
from quillspark.plans.parse import parse_documents
from quillspark.sources import parts


class Caught(Exception):
    pass


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(calibrate, "parse_documents", lambda docs, **o: seen.append(docs.count()) or parse_documents(docs, **o))
    rows = [(s, m, "no layout at all, but long enough", None, 0.5) for s in "ab" for m in "xy"] + [("c", "x", None, "failed", 0.5)]
    read = spark.createDataFrame(rows, "stem string, model string, text string, error string, elapsed_seconds double")
    got = sorted((r["stem"], r["model"], r["ok"], r["parse_ok"], r["parse_error"]) for r in calibrate.calibrated(read).collect())
    assert seen == [2]
    assert [g[:4] for g in got] == [("a", "x", True, False), ("a", "y", True, False), ("b", "x", True, False), ("b", "y", True, False), ("c", "x", False, False)]
    assert all(g[4].startswith("parse_failed") for g in got[:4]) and got[4][4] is None


def test_payloads_alone_need_no_layouts(spark):
    df = spark.createDataFrame([(1, "x")], "k int, qr_payload string")
    assert "燃油附加费" not in _plan(parse_documents(df)) and "燃油附加费" in _plan(parse_documents(df.withColumn("text", F.lit("x"))))


def test_places_are_compiled(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([None, 0, 1, 4, 5, 9, 10])], "i int, x long")
    placed = df.select("i", registry._place(F.col("x"), [1, 5, 9]).alias("p"))
    assert "lambda" not in _plan(placed) and [r["p"] for r in placed.orderBy("i").collect()] == [0, 0, 1, 1, 2, 3, 3]
    assert df.select(registry._place(F.col("x"), []).alias("p")).first()["p"] == 0


def test_values_as_columns():
    assert _replacing(iter(["bcd", "ab"]), ["2", "1"].__getitem__)("abcd ab") == "a2 1"
    assert _replacing(iter([]), [].__getitem__)("x") == "x"


def test_files_stream_through():
    for pack in (1, 2, 18):
        out = io.BytesIO()
        queries_records._pack(pack, ((pack, k, "1.50") for k in range(50)), out)
        rows = [r for b in parts.rows_of("p", out.getvalue()) for r in b.to_pylist()]
        assert len(rows) == {1: 50, 2: 51, 18: 1}[pack] and rows[-1]["kind"] == {1: "stream", 2: "xml", 18: "broken"}[pack]


def test_parts_are_held_as_columns(monkeypatch):
    monkeypatch.setattr(parts, "BATCH_BYTES", 6000)
    content = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n<< /Filter /FlateDecode >>\nstream\n" % k + zlib.compress(b"said") + b"\nendstream\nendobj\n" for k in range(100))
    batches = parts.rows_of("p", content)
    assert sum(map(len, batches)) == 100 and max(map(len, batches)) < 20
    assert parts.rows_of("p", b"no file of ours") == []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "<a/>")
    damaged = out.getvalue().replace(b"<a/>", b"<b/>")
    assert [r["kind"] for b in parts.rows_of("p", damaged) for r in b.to_pylist()] == ["broken"]


@pytest.mark.parametrize("query,step,most", [("sanitize_records", "saved", 1), ("incremental_runs", "parse_new", 0)])
def test_documents_are_rendered_once(spark, monkeypatch, query, step, most):
    def caught(df, *_):
        assert _plan(df).count("Relation [l_orderkey") == most
        raise Caught

    monkeypatch.setattr(queries_records, step, caught)
    with pytest.raises(Caught):
        getattr(queries_records, query)(spark, "/root/testdata/sf0.001")


def test_quarters_are_not_one_tasks_files(spark, monkeypatch):
    written = []
    original = queries_records.stream_totals
    monkeypatch.setattr(queries_records, "stream_totals", lambda stream, out, *rest: written.append(out) or original(stream, out, *rest))
    queries_records.streamed_totals(spark.newSession(), "/root/testdata/sf0.001").count()
    assert len(written) == 5  # a run a quarter, whatever the number of its files, and one that closes the windows
