"""Layouts, routing, the error ladder and bytes, on texts written for these tests."""

import io
import json
import zipfile
import zlib

import pytest

from quillspark.plans.parse import batch_summary, error_documents, exit_code, parse_documents, to_json
from quillspark.sources.documents import open_container, pdf_metadata, read_bytes

GENERAL = """电子发票（普通发票）
发票号码：24100000000000000011
开票日期：2024年 3月 9日
名 称：甲方科技有限公司 名 称：乙方商店
统一社会信用代码/纳税人识别号：911100000000000AAA 统一社会信用代码/纳税人识别号：922200000000000BBB
项目名称 规格型号 单位 数量 单价 金额 税率/征收率 税额
*纸张*
A4 100.00 13% 13.00
*笔* 5.50 免税 *
合 计 ¥105.50 ¥13.00
价税合计（大写） 壹佰壹拾捌圆伍角 （小写） ¥118.50
开票人：赵六
"""
RAIL = """中国铁路电子客票
发票号码:25000000000000000077
开票日期:2025年1月2日
购买方名称:甲方科技有限公司 统一社会信用代码:911100000000000AAA
电子客票号:E77
北站 G1 南站
北城 G12 南城
2025年01月03日 7:05开 5车1号 二等座
110000********1234 钱七
¥88.5
"""
NOTHING = "a readable text that is no invoice at all"


def rows(spark, data, schema, **options):
    return {r["case"]: r for r in parse_documents(spark.createDataFrame(data, schema), **options).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    data = [("general", GENERAL), ("crlf", GENERAL.replace("\n", "\r\n")), ("rail", RAIL), ("nothing", NOTHING), ("near", "发票 " + NOTHING), ("null", None),
            ("control", "\x01\x02" * 40)]
    return rows(spark, data, "case string, text string")


def test_general(texts):
    for case in ("general", "crlf"):
        d = texts[case]["data"]
        assert (texts[case]["layout"], texts[case]["status"], d["document_type"], d["invoice_type"]) == ("general", "ok", "pdf-fapiao", "digital_general")
        assert (d["invoice_number"], d["issue_date"]) == ("24100000000000000011", "2024-03-09")
        assert (d["buyer"]["name"], d["seller"]["name"], d["buyer"]["tax_id"]) == ("甲方科技有限公司", "乙方商店", "911100000000000AAA")
        assert (d["amount_without_tax"], d["tax_amount"], d["amount_with_tax"], d["amount_in_words"]) == ("105.50", "13.00", "118.50", "壹佰壹拾捌圆伍角")
        assert [(i["name"], i["amount"], i["tax_rate"], i["tax_amount"]) for i in d["items"]] == [
            ("*纸张* A4", "100.00", "13%", "13.00"), ("*笔*", "5.50", "免税", "0.00")]
        assert d["remark"] == "开票人:赵六" and d["source"]["extracted_by"] == "text_layer"


def test_rail(texts):
    d = texts["rail"]["data"]
    trip = d["extra"]["rail_12306"]
    assert (d["document_type"], d["amount_with_tax"], d["seller"]["name"]) == ("pdf-rail-12306", "88.50", "中国铁路")
    assert (trip["from_station"], trip["train_no"], trip["to_station"], trip["depart_time"]) == ("北城", "G12", "南城", "2025-01-03 07:05:00")
    assert (trip["passenger_name"], trip["seat_type"], d["remark"]) == ("钱七", "二等座", "电子客票号:E77")


def test_errors_are_data(texts):
    assert {k: texts[k]["code"] for k in ("nothing", "near", "null", "control")} == {
        "nothing": "parse_failed", "near": "rule_unhandled", "null": "rule_unhandled", "control": "rule_unhandled"}
    assert texts["near"]["engine"]["ocr_required"] and texts["near"]["document_type"] == "pdf-fapiao"


def test_ladder_metadata_qr_ocr(spark):
    data = [
        ("metadata", None, "x", "auto", {"InvoiceNumber": "7", "IssueTime": "2024年5月6日"}), ("qr", None, "01,32,20240506,12345678,9.90,0.10,ABCDEFGHIJKLMNOP", "auto", None),
        ("bad qr", None, "hello", "auto", None), ("ocr", GENERAL, None, "auto", None), ("off", GENERAL, None, "disabled", None), ("short", "x", None, "auto", None)]
    got = rows(spark, data, "case string, ocr_text string, qr_payload string, ocr_mode string, metadata map<string,string>", ocr_vendor="v")
    assert got["metadata"]["data"]["issue_date"] == "2024-05-06"
    q = got["qr"]["data"]
    assert (q["invoice_number"], q["issue_date"], q["amount_with_tax"], q["tax_amount"], q["checksum"]) == ("20240506", "2024-05-06", "9.90", "0.10", "ABCDEFGHIJKLMNOP")
    assert (got["bad qr"]["code"], got["off"]["code"], got["short"]["code"]) == ("parse_failed", "rule_unhandled", "parse_failed")
    assert got["ocr"]["data"]["source"]["ocr_vendor"] == "v" and got["ocr"]["engine"]["ocr_used"]


def container(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


AIR = container({"OFD.xml": "<o/>", "Doc_0/Attachs/atr_1.xml": (
    "<r xmlns='u'><ElectronicInvoiceAirTransportReceiptNumber>A9</ElectronicInvoiceAirTransportReceiptNumber><TotalAmount>10.005</TotalAmount>"
    "<IssueDate>2024-05-06</IssueDate><VatRate>0.09</VatRate></r>")})
INVOICE = container({"x/OFD.xml": "<o/>", "Doc_0/Pages/Page_0/Content.xml": '<p><TextObject Boundary="0 9 1 1"><TextCode>发票号码</TextCode></TextObject></p>'})
PDF = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(
    b"/InvoiceNumber(24000000000000000001)/SellerName(\xfe\xff" + "乙方".encode("utf-16-be") + b")/TotalTax-includedAmount(7.5)") + b"\nendstream"


def test_bytes(spark):
    data = [("air", AIR), ("ofd invoice", INVOICE), ("zip", container({"a.txt": "x"})), ("pdf", PDF), ("png", b"\x89PNG\r\n\x1a\n123"), ("junk", b"junk"), ("empty", b""),
            ("null", None), ("broken", b"PK\x03\x04junk")]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in data], "case string, content binary")
    parsed = parse_documents(df, text_layer=lambda b: "\x01\x02")
    got = {r["case"]: r for r in parsed.collect()}
    air = got["air"]["data"]
    assert (air["document_type"], air["invoice_number"], air["amount_with_tax"], air["items"][0]["tax_rate"]) == ("ofd-air-itinerary", "A9", "10.00", "0.09")
    assert (got["pdf"]["data"]["invoice_number"], got["pdf"]["data"]["seller"]["name"], got["pdf"]["data"]["amount_with_tax"]) == ("24000000000000000001", "乙方", "7.50")
    assert {k: got[k]["code"] for k in ("ofd invoice", "zip", "png", "junk", "empty", "null", "broken")} == {
        "ofd invoice": "not_implemented", "zip": "unsupported_format", "png": "not_implemented", "junk": "unsupported_format", "empty": "invalid_input",
        "null": "invalid_input", "broken": "unsupported_format"}
    assert got["ofd invoice"]["document_type"] == "ofd-fapiao"
    total = batch_summary(parsed).first()
    assert (total["total"], total["succeeded"], total["failed"]) == (9, 2, 7)
    assert {json.loads(r["error"])["status"] for r in error_documents(parsed).collect()} == {"error"}
    assert all(json.loads(r["json"])["remark"] is None for r in to_json(parsed).where("json like '%24000000000000000001%'").collect())


def test_container_limits_and_metadata():
    assert open_container(b"no zip")["broken"] and open_container(AIR)["is_ofd"]
    assert pdf_metadata(b"%PDF- /BuyerName(x)") == {}


def test_single_document_and_exit_codes(spark):
    one = parse_documents(read_bytes(spark, b"", "a.pdf")).select("code", exit_code(__import__("pyspark.sql.functions", fromlist=["col"]).col("code")).alias("exit")).first()
    assert (one["code"], one["exit"]) == ("invalid_input", 2)


def test_text_only_plan_has_no_python(spark):
    plan = parse_documents(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
