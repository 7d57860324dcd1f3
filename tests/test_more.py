"""The command, failing files and functions, OCR shapes, profiles, SQL functions, calibration, layouts not seen elsewhere."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_parse import AIR, GENERAL, INVOICE, PDF, container

from quillspark import cli
from quillspark.operators.payloads import result_line
from quillspark.operators.profiles import capabilities, profile_name, resolved
from quillspark.plans import calibrate, tables
from quillspark.plans.parse import parse_documents
from quillspark.sources.documents import PageReader, container_images, open_container, pdf_metadata


def test_damaged_files_are_data():
    rnd = random.Random(5)
    for good in (AIR, INVOICE, PDF):
        for _ in range(1500):
            bad = bytearray(good)
            for _ in range(rnd.randint(1, 3)):
                bad[rnd.randrange(len(bad))] = rnd.randrange(256)
            open_container(bytes(bad))
            pdf_metadata(bytes(bad))
            container_images(bytes(bad))


def test_metadata_beyond_the_first_pieces():
    body = zlib.compress(b" " * (70 << 20) + b"/InvoiceNumber(24000000000000000009)")
    assert pdf_metadata(b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream") == {"InvoiceNumber": "24000000000000000009"}


def test_page_reader():
    r = PageReader()
    r.read(b"<a xmlns='u'>x<b> </b><b>y</b><c><b>z</b></c><TextObject Boundary='5 7 1 1'><CGTransform>no</CGTransform><TextCode>t1</TextCode><TextCode>t2</TextCode></TextObject></a>")
    assert (r.fields["b"], r.fields["c"], r.placed) == ("y", "z", [(7.0, 5.0, "t1t2")]) and r.fields["a"].startswith("x")
    r.read(b"<broken")
    assert len(r.placed) == 1


def test_failing_functions_and_pictures(spark):
    def fails(content: bytes) -> str:
        raise RuntimeError("no")

    pictured = container({"OFD.xml": "<o/>", "Doc_0/Res/a.png": "发票号码 in a picture"})
    df = spark.createDataFrame([("pdf", bytearray(b"%PDF-x")), ("ofd", bytearray(pictured)), ("junk", bytearray(b"junk"))], "case string, content binary")
    got = {r["case"]: (r["code"], r["document_type"]) for r in parse_documents(df, ocr_vendor="v", ocr=lambda b: b.decode("utf-8", "ignore")).collect()}
    assert got == {"pdf": ("parse_failed", None), "ofd": ("not_implemented", "ofd-fapiao"), "junk": ("unsupported_format", None)}
    got = {r["case"]: r["code"] for r in parse_documents(df, ocr_vendor="v", ocr=fails).collect()}
    assert got == {"pdf": "internal_error", "ofd": "internal_error", "junk": "unsupported_format"}
    large = parse_documents(df, max_bytes=5).where("case = 'ofd'").first()
    assert large["code"] == "invalid_input"


def test_ocr_inputs(spark):
    rows = [("lines", [{"text": x} for x in GENERAL.splitlines()], None), ("answer", None, json.dumps({"text": GENERAL})), ("neither", None, "{}"), ("no json", None, "x")]
    df = spark.createDataFrame(rows, "case string, ocr_lines array<struct<text:string>>, ocr_payload string").withColumn("format", F.lit("image"))
    got = {r["case"]: (r["code"], r["data"] and r["data"]["invoice_number"]) for r in parse_documents(df, ocr_vendor="v").collect()}
    number = "24100000000000000011"
    assert got == {"lines": (None, number), "answer": (None, number), "neither": ("parse_failed", None), "no json": ("parse_failed", None)}


def test_result_shapes():
    shapes = [{"text": " a ", "score": "0.5", "position": [[1, 2]]}, ("a", 0.5, [[1, 2]]), ([[1, 2]], ("a", 0.5)), ("a", 0.5), ["a"], (), {"text": None}, ("a", "x")]
    got = [tuple(result_line(x).values()) for x in shapes]
    assert got == [("a", 0.5, [[1, 2]])] * 3 + [("a", 0.5, None), ("a", None, None), ("", None, None), ("", None, None), ("a", None, None)]


def test_profiles(spark):
    assert resolved(" doc ")["rec_model"] == "doc-densenet_lite_136-gru" == resolved(None)["rec_model"]
    with pytest.raises(ValueError):
        resolved("none such")
    assert capabilities()["formats"]["image"] == "not_implemented" and "ocr" not in capabilities("v")
    assert len(capabilities("v", local_ocr=True, profile="invoice")["ocr"]["available_model_profiles"]) == 4
    assert spark.range(1).select(profile_name(F.lit("x")), profile_name(F.lit(None).cast("string"))).first() == (None, "invoice-lite")


def test_sql_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(bytearray(AIR),), (bytearray(PDF),), (bytearray(b"junk"),)], "content binary").createOrReplaceTempView("files")
    rows = spark.sql("SELECT o.format, o.fields FROM files, LATERAL open_document(content) o").collect()
    assert {r["format"] for r in rows} == {"ofd", "pdf"} and any(r["fields"].get("TotalAmount") == "10.005" for r in rows)
    assert [r["line"] for r in spark.sql("""SELECT * FROM ocr_answer_lines('{"text": "a\\\\nb"}')""").collect()] == ["a", "b"]
    spark.createDataFrame([(GENERAL,)], "text string").createOrReplaceTempView("texts")
    tables.parsed_view(spark, "texts", "parsed")
    assert spark.sql("SELECT data.amount_with_tax FROM parsed").first()[0] == "118.50"


def test_command(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(PDF)
    assert cli.main(["parse", str(tmp_path / "a.pdf"), "--pretty"]) == 0
    assert json.loads(capsys.readouterr().out)["data"]["invoice_number"] == "24000000000000000001"
    (tmp_path / "b").write_bytes(b"junk")
    assert cli.main(["parse", str(tmp_path / "b")]) == 3 and json.loads(capsys.readouterr().err.splitlines()[-1])["code"] == "unsupported_format"
    assert cli.main(["parse", str(tmp_path / "none")]) == 2
    assert cli.main(["capabilities"]) == 0 and json.loads(capsys.readouterr().out)["formats"]["pdf"] == "supported"
    for bad in (["parse"], ["parse", "x", "--hint", "exe"], []):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_calibration(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_text(GENERAL)
    (tmp_path / "in" / "b.jpg").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.txt").write_text("x")
    read = calibrate.recognised(calibrate.samples(spark, str(tmp_path / "in")), "m", lambda: lambda b: b.decode())
    records = calibrate.calibrated(read)
    got = {r["stem"]: (r["ok"], r["parse_ok"]) for r in records.collect()}
    assert got == {"a": (True, True), "b": (False, False)}
    expected = records.where("stem = 'a'").select("stem", "data")
    summary = calibrate.write_calibration(calibrate.calibrated(read, expected), str(tmp_path / "out")).first()
    assert (summary["total"], summary["ok"], summary["parse_ok"], summary["match_invoice_number"]) == (2, 1, 1, 1)
    took = tables.timed_batch(records.select("stem", F.when(F.col("parse_ok"), "ok").otherwise("error").alias("status")), str(tmp_path / "timed"))
    assert (took["total"], took["failed"]) == (2, 1) and took["elapsed_ms"] == took["elapsed_us"] // 1000


SPLIT = """电子发票（普通发票）
发票代码：033001800211
发票号码：24100000000000000012
开票日期：2024年03月09日
名 称：甲方科技有限公司 名 称：乙方商店
项目名称
金额
*纸张*
¥100.00
13%
¥13.00
合
计
¥
¥
¥100.00
¥13.00
价税合计
壹佰壹拾叁圆整 ¥113.00
"""
TICKETS = """电子发票（普通发票）
发票号码：24100000000000000013
开票日期：2024年03月09日
门票 2 50.00 94.34 5.66 100.00
成人票
合 计 ¥94.34 ¥5.66
价税合计（大写） 壹佰圆整 （小写） ¥100.00
"""


def test_split_columns_and_tickets(spark):
    df = spark.createDataFrame([("split", SPLIT), ("tickets", TICKETS), ("wide", SPLIT.replace("¥", "￥").replace("\n", "\r\n"))], "case string, text string")
    got = {r["case"]: r["data"] for r in parse_documents(df).collect()}
    for case in ("split", "wide"):
        d = got[case]
        assert (d["invoice_code"], d["amount_without_tax"], d["tax_amount"], d["amount_with_tax"], d["amount_in_words"]) == ("033001800211", "100.00", "13.00", "113.00", "壹佰壹拾叁圆整")
        assert [(i["name"], i["amount"], i["tax_rate"], i["tax_amount"]) for i in d["items"]] == [("*纸张*", "100.00", "13%", "13.00")]
    t = got["tickets"]["items"]
    assert [(i["name"], i["unit_price"], i["amount"], i["tax_rate"], i["tax_amount"]) for i in t] == [("门票成人票", "50.00", "100.00", "0.06", "5.66")]
