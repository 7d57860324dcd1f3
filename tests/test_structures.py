"""Parts of files, pages, differences, glyph lines, registries, ledgers and stream totals on odd inputs, by brute force where there is one."""

import datetime
import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators.diffing import aligned, compared, differences
from quillspark.operators.glyphs import polygon_box, text_lines
from quillspark.plans.ledger import parse_new, parsed_before, parsed_of
from quillspark.plans.pages import first_hits, joined_pages, page_texts
from quillspark.plans.registry import as_of, in_ranges
from quillspark.sources.documents import pdf_metadata
from quillspark.sources.parts import parts_of, planned, register_parts, rows_of

RND = random.Random(8)


def box(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def pdf(*bodies, head=b"<< /Filter /FlateDecode >>"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (i, head, zlib.compress(b)) for i, b in enumerate(bodies))


def test_parts_of_files(spark, tmp_path):
    files = {"a.ofd": box({"OFD.xml": "<o/>", "d/x.PNG": b"png", "d/y": b"raw", "e.xml": "é"}), "b.pdf": pdf(b"one", b"two"), "c.pdf": pdf(b"one", head=b"<< /Length 3 >>"), "d.bin": b"neither",
             "cut.ofd": box({"OFD.xml": "<o/>" * 100})[:60], "empty.pdf": b"", "sub/e.pdf": pdf(b"three", head=b"<<" + b" " * 9000 + b"/Filter [ /FlateDecode ] " + b" " * 9000 + b">>")}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    register_parts(spark)
    rows = spark.read.format("document_parts").option("partitionBytes", 100).load(str(tmp_path)).collect()
    got = sorted((r["path"].removeprefix(str(tmp_path) + "/"), r["ordinal"], r["kind"], r["text"] or bytes(r["content"] or b"").decode()) for r in rows)
    assert got == [("a.ofd", 0, "xml", "<o/>"), ("a.ofd", 1, "image", "png"), ("a.ofd", 2, "entry", "raw"), ("a.ofd", 3, "xml", "é"), ("b.pdf", 0, "stream", "one"), ("b.pdf", 1, "stream", "two"),
                   ("cut.ofd", 0, "broken", ""), ("sub/e.pdf", 0, "stream", "three")]
    assert spark.read.format("document_parts").option("pattern", r"b\..*").load(str(tmp_path)).count() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("document_parts").load(str(tmp_path / "none")).count() == 0


def test_parts_as_a_stream(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    register_parts(spark)
    for n in range(2):
        (inbox / f"{n}.pdf").write_bytes(pdf(b"x%d" % n, b"y"))
        stream = spark.readStream.format("document_parts").load(str(inbox))
        query = stream.select("text").writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
        query.processAllAvailable()
        query.stop()
        assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == sorted(["x0", "y", "x1", "y"][: 2 * n + 2])


def test_files_are_dealt_by_size():
    files = [(str(i), RND.randint(0, 100)) for i in range(200)] + [("large", 5000)]
    parts = planned(files, 1000)
    sizes = dict(files)
    assert sorted(p for x in parts for p in x) == sorted(sizes) and planned([], 10) == []
    loads = sorted(sum(sizes[p] for p in x) for x in parts)
    assert loads[-1] == 5000 or loads[-2] < 2500


def test_damage_gives_rows():
    good = [box({"OFD.xml": "<o/>", "a.xml": "<a/>" * 50}), pdf(b"one" * 50, b"two")]
    for data in good:
        for _ in range(500):
            bad = bytearray(data)
            bad[RND.randrange(len(bad))] = RND.randrange(256)
            rows_of("x", bytes(bad))
    assert list(parts_of(b"")) == []


def test_metadata_across_pieces_and_damage():
    number = b"/InvoiceNumber(" + b" " * (3 << 20) + b"24000000000000000009)"
    assert pdf_metadata(pdf(b" " * ((1 << 20) - 7) + number))["InvoiceNumber"] == "24000000000000000009"
    whole = pdf(b"/InvoiceNumber(1) /IssueTime(2)" + bytes(RND.choice(b'abcdefgh') for _ in range(20000)))
    at = whole.index(b"stream\n") + 7
    assert pdf_metadata(whole) and pdf_metadata(whole[: at + 3000] + b"\nendstream") == {}
    assert pdf_metadata(pdf(b"/InvoiceNumber(1)", head=b"<< /Filter /FlateDecode" + b" " * 6000 + b"<< >> >>")) == {"InvoiceNumber": "1"}


def test_pages(spark, tmp_path):
    rows = [("a", b"one\ftwo\f\fbad\f three "), ("b", b"bad"), ("c", None), ("d", b"whole")]
    files = spark.createDataFrame(rows, "k string, content binary")
    marks = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()

        def read(page):
            if page == b"bad":
                raise ValueError
            return page.decode()

        return read

    def cut(content):
        if content == b"whole":
            raise KeyError
        return content.split(b"\f")

    got = {r["k"]: tuple(r)[1:] for r in joined_pages(page_texts(files.repartition(1), "k", cut, make), "k").collect()}
    assert got == {"a": (5, 1, "one\ntwo\nthree"), "b": (1, 1, None), "d": (0, 1, None)}
    assert len(list(tmp_path.iterdir())) == 1  # one provider for the task's worker

    ladder = [("plain", lambda p: p), ("none", lambda p: None), ("upper", lambda p: p.upper())]

    def reader():
        def read(page):
            if page == b"bad":
                raise ValueError
            return page.decode() if page.isupper() else None

        return read

    got = {r["k"]: tuple(r)[1:] for r in first_hits(files, "k", cut, ladder, reader).collect()}
    assert got == {"a": (0, "upper", "ONE", 2, None), "b": (0, "upper", "BAD", 2, None), "c": (None, None, None, 0, None), "d": (None, None, None, 0, "KeyError")}


def test_alignment_is_longest():
    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(300):
        a, b = ([RND.randint(0, 3) for _ in range(RND.randint(0, 8))] for _ in range(2))
        pairs = aligned(a, b)
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert len(both) == length(a, b) and all(a[i] == b[j] for i, j in both)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_differences(spark):
    assert list(compared("x", {"a": [1, 2, 3]}, {"a": [1, 3]})) == [("x.a[1]", "missing", "2", None)]
    assert list(compared("", {"a": [{"n": 1, "m": 1}]}, {"a": [{"n": 2, "m": 1}, {"n": 3, "m": 0}]})) == [("a[0].n", "changed", "1", "2"), ("a[1]", "extra", None, '{"m": 0, "n": 3}')]
    kind = "k long, data struct<a:string,l:array<struct<n:int>>,m:map<string,string>>"
    one = spark.createDataFrame([(1, ("x", [(1,), (2,)], {"p": "q"})), (2, None), (None, ("n", None, None)), (4, ("gone", [], {})), (5, (None, None, None))], kind)
    two = spark.createDataFrame([(1, ("y", [(2,)], {"p": "r"})), (2, ("new", None, None)), (None, ("n", None, None)), (5, (None, None, None)), (6, None)], kind)
    got = sorted((str(r["k"]), r["path"], r["kind"]) for r in differences(one, two, "k").collect())
    assert got[:3] == [("1", "a", "changed"), ("1", "l[0]", "missing"), ("1", "m.p", "changed")] and [x for x in got[3:]] == [("2", "", "extra"), ("4", "", "missing"), ("6", "", "extra")]
    assert differences(one, one, "k").count() == 0 and differences(one.limit(0), one.limit(0), "k").count() == 0


def test_glyphs_without_lines(spark):
    rows = [("p", x * 6.0, y + x % 2, x * 6.0 + 5, y + x % 2 + 8, c) for y, text in ((0.0, "first"), (11.0, "second"), (60.0, "x")) for x, c in enumerate(text)]
    RND.shuffle(rows)
    rows += [("p", None, 1.0, 2.0, 3.0, "?"), ("p", 1.0, 1.0, 2.0, 3.0, None), ("q", 0.0, 5.0, 1.0, 6.0, "q")]
    out = text_lines(spark.createDataFrame(rows, "page string, x0 double, y0 double, x1 double, y1 double, char string"), ["page"]).orderBy("page", "line").collect()
    assert [(r["page"], r["line"], r["text"], r["y1"]) for r in out] == [("p", 0, "first", 9.0), ("p", 1, "second", 20.0), ("p", 2, "x", 68.0), ("q", 0, "q", 6.0)]
    frames = spark.createDataFrame([([(1.0, 2.0), (3.0, 0.0)],), ([],), (None,)], "p array<struct<x:double,y:double>>").select(polygon_box(F.col("p")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in frames] == [(1.0, 0.0, 3.0, 2.0), None, None]


@pytest.mark.parametrize("parts", [1, 2, 16])
def test_as_of_by_brute_force(spark, parts):
    day = datetime.datetime(2024, 1, 1)
    registry = [(RND.choice("aab"), day + datetime.timedelta(days=RND.randint(0, 40)), RND.randint(0, 9)) for _ in range(60)] + [(None, day, 1), ("a", None, 1)]
    records = [(i, RND.choice(["a", "a", "b", "c", None]), day + datetime.timedelta(days=RND.randint(-5, 45))) for i in range(200)] + [(200, "a", None), (3, "a", day)]
    got = as_of(spark.createDataFrame(records, "id int, who string, at timestamp"), spark.createDataFrame(registry, "who string, since timestamp, v int"), "who", "at", "since", ["v"], parts)

    def plain(who, at):
        rows = [(t, v) for w, t, v in registry if w and t and at and w == who and t <= at]
        return max(rows)[1] if rows else None

    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, w, t, plain(w, t))) for i, w, t in records)


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_ranges_by_brute_force(spark, parts):
    points = [(i, RND.randint(-50, 150)) for i in range(200)] + [(200, None)]
    ranges = [(i, *sorted(RND.randint(0, 100) for _ in range(2))) for i in range(50)] + [(50, 0, 100), (51, None, 5), (52, 7, None), (53, 9, 3)]
    got = in_ranges(spark.createDataFrame(points, "p int, x int"), spark.createDataFrame(ranges, "r int, low int, high int"), "x", "low", "high", parts)
    want = [(p, r) for p, x in points for r, lo, hi in ranges if x is not None and lo is not None and hi is not None and lo <= x < hi]
    assert sorted((r["p"], r["r"]) for r in got.collect()) == sorted(want)


def test_runs_parse_what_is_new(spark, tmp_path):
    out, seen = str(tmp_path / "out"), []

    def parse(df):
        seen.append(df.count())
        return df.withColumn("parsed", F.upper("text")).drop("text")

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, text string")
    assert parsed_before(spark, out, "1") is None and "parsed" not in parsed_of(docs, out, F.col("text"), "1").columns
    parse_new(docs, out, parse, F.col("text"), "1")
    parse_new(docs, out, parse, F.col("text"), "1")
    parse_new(docs.unionByName(spark.createDataFrame([(5, "c")], "k int, text string")), out, parse, F.col("text"), "1")
    parse_new(docs, out, parse, F.col("text"), "2")
    assert seen == [2, 0, 1, 2]
    assert sorted((r["k"], r["parsed"]) for r in parsed_of(docs, out, F.col("text"), "1").select("k", "parsed").collect()) == [(1, "A"), (2, "B"), (3, "A"), (4, None)]
