"""Queries over the driver's tables that exercise every document operator, each with DuckDB SQL that computes the same.

Documents are rendered from orders and lines, parsed, and compared with what the tables say; the SQL never parses a text.
"""

from __future__ import annotations

import io
import shutil
import tempfile
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillspark import queries_records
from quillspark.functions.money import date_text, money, percent
from quillspark.operators.answers import with_answer_text
from quillspark.operators.comparing import FIELDS, line_boxes, model_summary, with_matches
from quillspark.operators.profiles import capability_table, profile_name
from quillspark.operators.pseudonyms import text_mentions, token_table
from quillspark.operators.routing import layout, unusable_text
from quillspark.operators.urls import url_allowed
from quillspark.plans import synth
from quillspark.plans.calibrate import calibrated, recognised
from quillspark.plans.parse import batch_summary, http_status, parse_documents
from quillspark.sources.documents import hinted_format, sniffed_format
from quillspark.sources.scratch import saved
from quillspark.streaming.ingest import parse_stream

BASE = """
WITH l AS (SELECT l_orderkey AS k, l_suppkey AS s, l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_tax * 100) AS BIGINT) AS r FROM lineitem),
i AS (SELECT *, (c * r + 50) // 100 AS x FROM l),
g AS (SELECT k, min(s) AS s, CAST(sum(c) AS BIGINT) AS net, CAST(sum(x) AS BIGINT) AS tax, count(*) AS n FROM i GROUP BY k),
b AS (SELECT g.*, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, '26' || lpad(CAST(k AS VARCHAR), 12, '0') || lpad(CAST(s AS VARCHAR), 6, '0') AS number,
  strftime(o_orderdate, '%Y-%m-%d') AS issued, '客户' || o_custkey || '科技有限公司' AS buyer, '供应' || s || '贸易有限公司' AS seller,
  '9111' || lpad(CAST(o_custkey AS VARCHAR), 13, '0') || 'A' AS buyer_id, '9222' || lpad(CAST(s AS VARCHAR), 13, '0') || 'B' AS seller_id
  FROM g JOIN orders ON o_orderkey = k)
"""


def _cents(x: str) -> str:
    return f"(({x}) // 100) || '.' || lpad(CAST(({x}) % 100 AS VARCHAR), 2, '0')"


def _fields(parsed: DataFrame) -> DataFrame:
    d = F.col("data")
    return parsed.select(
        F.col("k"), d["invoice_type"].alias("invoice_type"), d["invoice_number"].alias("invoice_number"), d["issue_date"].alias("issue_date"),
        d["buyer"]["name"].alias("buyer"), d["buyer"]["tax_id"].alias("buyer_id"), d["seller"]["name"].alias("seller"), d["seller"]["tax_id"].alias("seller_id"),
        d["amount_without_tax"].alias("net"), d["tax_amount"].alias("tax"), d["amount_with_tax"].alias("gross"), F.size(d["items"]).alias("n_items"))


def _parsed(spark: SparkSession, sf_dir: str, form: str, **options) -> DataFrame:
    return parse_documents(synth.rendered(spark, sf_dir, form, **options))


def _field_sql(kind: str = "digital_general", net: str = "net", tax: str = "tax", gross: str = "net + tax", n: str = "n", base: str = BASE, table: str = "b") -> str:
    tax_text = "CAST(NULL AS VARCHAR)" if tax == "NULL" else _cents(tax)
    return base + f"""SELECT k, '{kind}' AS invoice_type, number AS invoice_number, issued AS issue_date, buyer, buyer_id, seller, seller_id,
      {_cents(net)} AS net, {tax_text} AS tax, {_cents(gross)} AS gross, CAST({n} AS INT) AS n_items FROM {table}"""


def parse_general_fields(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, "general"))


def parse_tax_free(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, "general", free=True))


def parse_special(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, "special"))


def parse_stacked_layout(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, "stacked"))


def parse_toll(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, "toll"))


FIRST_LINE = BASE + """, f AS (SELECT k, c, x, row_number() OVER (PARTITION BY k ORDER BY p, c, r, x) AS at1 FROM i),
b1 AS (SELECT b.*, f.c AS fc, f.x AS fx FROM b JOIN f ON b.k = f.k AND f.at1 = 1)
"""


def parse_items_exploded(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "general")
    items = parsed.select("k", F.explode("data.items").alias("x"))
    return items.select("k", *[F.col(f"x.{f}").alias(f"item_{f}") for f in ("name", "amount", "tax_rate", "tax_amount")])


def parse_rail(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "rail")
    r = F.col("data.extra.rail_12306")
    return parsed.select("k", F.col("data.document_type").alias("document_type"), F.col("data.invoice_number").alias("invoice_number"),
                         F.col("data.issue_date").alias("issue_date"), F.col("data.buyer.name").alias("buyer"), F.col("data.amount_with_tax").alias("gross"),
                         F.col("data.remark").alias("remark"), *[r[f].alias(f) for f in (
                             "passenger_name", "id_no_masked", "train_no", "from_station", "to_station", "depart_time", "seat_type")])


def parse_air_text(spark, sf_dir):
    docs = synth.rendered(spark, sf_dir, "air").select("k", F.col("text").alias("ocr_text"), F.lit("image").alias("format"))
    parsed = parse_documents(docs, ocr_vendor="fake")
    a = F.col("data.extra.air_itinerary")
    return parsed.select("k", F.col("data.document_type").alias("document_type"), F.col("data.invoice_number").alias("invoice_number"),
                         F.col("data.issue_date").alias("issue_date"), F.col("data.buyer.name").alias("buyer"), F.col("data.amount_without_tax").alias("net"),
                         F.col("data.tax_amount").alias("tax"), F.col("data.amount_with_tax").alias("gross"), F.col("engine.ocr_used").alias("ocr_used"),
                         *[a[f].alias(f) for f in ("passenger_name", "flight_no", "from_station", "to_station", "depart_time", "tax_rate", "e_ticket_number")])


def parse_qr(spark, sf_dir):
    docs = synth.invoices(spark, sf_dir).select("k", synth.qr().alias("qr_payload"))
    d = F.col("data")
    return parse_documents(docs).select("k", *[d[f].alias(f) for f in ("invoice_number", "invoice_code", "issue_date", "amount_with_tax", "checksum")],
                                        d["source"]["extracted_by"].alias("extracted_by"))


def parse_air_fields(spark, sf_dir):
    """Itineraries given as fields of a container."""
    i = synth.invoices(spark, sf_dir)
    pairs = {
        "ElectronicInvoiceAirTransportReceiptNumber": synth.number(), "IssueDate": F.date_format("day", "yyyy-MM-dd"), "CarrierDate": F.date_format("day", "yyyy-MM-dd"),
        "DepartureTime": F.lit("08:15"), "Fare": synth.cents_text(F.col("net")), "VatTaxAmount": synth.cents_text(F.col("tax")), "TotalAmount": synth.cents_text(F.col("net") + F.col("tax")),
        "VatRate": F.lit("0.090"), "Flight": F.concat(F.lit("CA"), F.col("k").cast("string")), "NameOfPurchaser": synth.buyer(), "ETicketNumber": F.lpad(F.col("k").cast("string"), 13, "7"),
        "Endorsement": F.lit("不得签转")}
    docs = i.select("k", F.lit("ofd").alias("format"), F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("fields"))
    d = F.col("data")
    return parse_documents(docs).select("k", d["document_type"].alias("document_type"), d["invoice_number"].alias("invoice_number"), d["buyer"]["name"].alias("buyer"),
                                        d["amount_with_tax"].alias("gross"), d["remark"].alias("remark"), d["extra"]["air_itinerary"]["depart_time"].alias("depart_time"),
                                        d["items"][0]["tax_rate"].alias("tax_rate"))


def parse_metadata(spark, sf_dir):
    """PDFs whose text cannot be read but whose metadata can."""
    i = synth.invoices(spark, sf_dir)
    pairs = {"InvoiceNumber": synth.number(), "IssueTime": F.date_format(F.add_months("day", 360), "yyyy年MM月dd日"), "TotalAmWithoutTax": synth.cents_text(F.col("net")), "TotalTaxAm": synth.cents_text(F.col("tax")),
             "TotalTax-includedAmount": synth.cents_text(F.col("net") + F.col("tax")), "BuyerName": synth.buyer(), "BuyerIdNum": synth.buyer_id(),
             "SellerName": synth.seller(), "SellerIdNum": synth.seller_id()}
    docs = i.select("k", F.lit("\x01\x02\x03").alias("text"), F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("metadata"))
    return _fields(parse_documents(docs))


def money_normalize(spark, sf_dir):
    """Amounts with a third decimal, signs and separators."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), "l_partkey")
    mills = F.col("c") * 10 + F.col("l_partkey") % 10
    text = F.concat(F.lit("¥ "), F.format_number(F.floor(mills / 1000), 0), F.lit("."), F.lpad((mills % 1000).cast("string"), 3, "0"))
    return lines.select("l_orderkey", "l_linenumber", text.alias("raw"), money(text).alias("normal"))


def date_normalize(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit("　"))).when(
        F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return orders.select("o_orderkey", date_text(text).alias("normal"))


_MAGIC = ["255044462D312E37", "FFD8FFE000104A46", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056", "424D", "504B0304", "00112233"]


def detect_format(spark, sf_dir):
    """First bytes dealt by id: PDF, JPEG, PNG, GIF, WebP, BMP, ZIP (an OFD if the id is even), junk; hints now and then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = (F.col("doc_id") % 8).cast("int")
    content = F.unhex(F.array(*map(F.lit, _MAGIC))[n])
    hint = F.when(F.col("doc_id") % 11 == 0, "image").when(F.col("doc_id") % 13 == 0, "exe")
    form = hinted_format(hint, sniffed_format(content, F.col("doc_id") % 16 == 6))
    return docs.select("doc_id", form.alias("format"))


def quality_gate(spark, sf_dir):
    """Documents' texts, every third with control characters put after each letter e, every seventh with an invoice's word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("e\x01\x02"))).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("发票"))).otherwise(text)
    return docs.select("doc_id", unusable_text(text).alias("unusable"))


_ROUTES = ["航空运输电子客票行程单", "旅客姓名 承运人 航班号 燃油附加费", "中国铁路", "电子发票（增值税专用发票）", "电子发票(普通发票)", "发票代码 发票号码 合计 购方 服务名称", "旅客姓名 承运人", "plain words"]


def layout_router(spark, sf_dir):
    """Documents' whole texts with a layout's marks behind them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.concat(F.col("text"), F.lit("\n"), F.array(*map(F.lit, _ROUTES))[(F.col("doc_id") % 8).cast("int")])
    return docs.select("doc_id", layout(text).alias("layout"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of good and bad inputs, by order key."""
    n = F.col("k") % 8
    good = synth.general()
    return synth.invoices(spark, sf_dir).select(
        "k", F.when(n == 1, "image").when(n == 2, "ofd").when(n == 3, "unknown").otherwise("pdf").alias("format"),
        F.when(n == 4, "exe").alias("hint_type"), F.when(n == 5, "never").otherwise("auto").alias("ocr_mode"),
        F.when(n == 6, "发票 whose layout nobody has seen before").when(n == 7, "a readable text that is no invoice").when(n == 0, good).alias("text"),
        F.when(n == 2, "发票号码 1").alias("container_text"))


def envelope_errors(spark, sf_dir):
    p = parse_documents(_mixed(spark, sf_dir))
    return p.select("k", "status", "code", http_status(F.col("code")).alias("http_status"), "document_type", F.col("engine.ocr_required").alias("ocr_required"))


def batch_totals(spark, sf_dir):
    return batch_summary(parse_documents(_mixed(spark, sf_dir)))


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected records and predictions that are wrong in one field or another, by key."""
    parsed = saved(_parsed(spark, sf_dir, "special").select("k", "data"), "parsed")  # both sides read it
    d = F.col("data")
    wrong = d.withField("invoice_number", F.when(F.col("k") % 5 == 0, F.lit("0")).otherwise(d["invoice_number"]))
    wrong = wrong.withField("buyer.name", F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise(d["buyer"]["name"]))
    return parsed, parsed.withColumn("data", wrong)


def field_accuracy(spark, sf_dir):
    expected, guessed = _predictions(spark, sf_dir)
    m = with_matches(guessed, expected, "k")
    return m.select("k", *[F.col(f"matches.{f.replace('.', '_')}").alias(f.replace(".", "_")) for f in FIELDS])


def model_accuracy(spark, sf_dir):
    expected, guessed = _predictions(spark, sf_dir)
    m = with_matches(guessed, expected, "k").withColumns({
        "model": F.when(F.col("k") % 2 == 0, "even").otherwise("odd"), "ok": F.col("k") % 3 != 0, "parse_ok": F.col("k") % 4 != 0,
        "elapsed_seconds": (F.col("k") % 10).cast("double") / 4})
    return model_summary(m).select("model", "total", "ok", "failed", "parse_ok", "parse_failed", "avg_elapsed_seconds", *[f"match_{f.replace('.', '_')}" for f in FIELDS])


def pseudonymize(spark, sf_dir):
    """Tokens of customers' companies by first order, found in rendered texts of the orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.lit("购买方 客户"), F.col("o_custkey").cast("string"), F.lit("科技有限公司 日期 "), F.date_format("o_orderdate", "yyyy年MM月dd日"),
                    F.lit(" 号码 "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(" 金额 ¥"), F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    mentions = text_mentions(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return token_table(mentions).where("category = 'company'").select("value", "n", "token")


_HOSTS = ["http://8.8.8.8/", "https://10.1.2.3/a", "https://localhost/x", "https://127.0.0.1:80/", "https://[0:0:0:0:0:0:0:1]/", "ftp://a.example.com/", "https://[::1]/",
          "https://8.8.4.4/", "https://[2001:4860::8888]/", "https://2130706433/", "https://[::ffff:10.0.0.1]/"]


def url_allow_list(spark, sf_dir):
    """Every page's address, and a host dealt by id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host = F.array(*map(F.lit, _HOSTS))[(F.col("page_id") % len(_HOSTS)).cast("int")]
    return pages.select("page_id", url_allowed(F.col("url")).alias("allowed"), url_allowed(host).alias("host_allowed"))


def rate_ties(spark, sf_dir):
    """Rates of a tenth of a percent, many of them ties, as shares of two decimals."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("r"))
    rate = F.concat(F.floor(F.col("r") / 10).cast("string"), F.lit("."), (F.col("r") % 10).cast("string"), F.lit("%"))
    return lines.select("l_orderkey", "l_linenumber", rate.alias("rate"), percent(rate).alias("share"))


def ocr_answers(spark, sf_dir):
    """Orders as the answers of OCR services, in six shapes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    key = F.col("k").cast("string")
    shapes = [
        F.concat(F.lit('{"text": " 号码 '), key, F.lit(' \\n\\n客户 '), F.col("c"), F.lit('"}')),
        F.concat(F.lit('{"lines": [{"text": " 号码 '), key, F.lit('", "score": 0.9}, 7, {"text": ""}, {"text": "客户 '), F.col("c"), F.lit('"}]}')),
        F.concat(F.lit('{"Response": {"MixedInvoiceItems": [{"Name": "号码", "Value": "'), key, F.lit('"}, {"OcrText": "客户 '), F.col("c"), F.lit('"}]}}')),
        F.concat(F.lit('{"SingleInvoiceInfos": [{"号码": "'), key, F.lit('", "x": {"Name": "客户", "Value": "'), F.col("c"), F.lit('"}}]}')),
        F.concat(F.lit('{"Response": {"a": [{"b": {"name": "'), key, F.lit('"}}, {"Value": "'), F.col("c"), F.lit('"}]}}')),
        F.lit('{"lines": 3}')]
    answer = F.when(F.col("k") % 7 == 6, F.lit("no json")).otherwise(F.array(*shapes)[(F.col("k") % 7 % 6).cast("int")])
    return with_answer_text(o.select("k", answer.alias("answer")), "answer", "text").drop("answer")


def model_profiles(spark, sf_dir):
    """Profiles meant by names dealt by id."""
    names = ["default", " doc ", "invoice", "scene-lite", "none such", "", "mobile-lite"]
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return c.select("c_custkey", profile_name(F.array(*map(F.lit, names))[(F.col("c_custkey") % 7).cast("int")]).alias("profile"))


def capability_rows(spark, sf_dir):
    return capability_table(spark, "fake")


def parse_key_values(spark, sf_dir):
    """Itineraries recognised as lines of keys and values."""
    i = synth.invoices(spark, sf_dir)
    text = F.concat_ws("\n", F.lit("航空运输电子客票行程单"), F.concat(F.lit("发票号码: "), synth.number()), F.lit("旅客姓名: 王五"), F.concat(F.lit("航班号: CA"), F.col("k").cast("string")),
                       F.lit("承运人: 某航"), F.concat(F.lit("日期: "), synth.day_text()), F.lit("时间: 09:30"), F.concat(F.lit("票价: "), synth.cents_text(F.col("net"))),
                       F.concat(F.lit("合计: "), synth.cents_text(F.col("net") + F.col("tax"))), F.lit("税率: 12.5%"), F.lit("签注: 不得退票"))
    parsed = parse_documents(i.select("k", text.alias("ocr_text"), F.lit("image").alias("format")), ocr_vendor="fake")
    a = F.col("data.extra.air_itinerary")
    return parsed.select("k", F.col("data.invoice_number").alias("invoice_number"), F.col("data.amount_with_tax").alias("gross"), F.col("data.remark").alias("remark"),
                         *[a[f].alias(f) for f in ("passenger_name", "flight_no", "carrier", "depart_time", "fare", "tax_rate")])


@F.pandas_udf(T.BinaryType())
def _as_ofd(number: pd.Series, total: pd.Series) -> pd.Series:
    """Containers with the fields of an itinerary; every seventh is cut off in the middle."""
    def one(number: str, total: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("OFD.xml", "<o/>")
            z.writestr("Doc_0/Attachs/atr_0.xml", f"<r><ElectronicInvoiceAirTransportReceiptNumber>{number}</ElectronicInvoiceAirTransportReceiptNumber><a><TotalAmount> {total} </TotalAmount></a></r>")
        return out.getvalue()

    made = [one(*x) for x in zip(number, total, strict=True)]
    return pd.Series([m[: len(m) // 2] if int(n[2:14]) % 7 == 0 else m for n, m in zip(number, made, strict=True)])


@F.pandas_udf(T.BinaryType())
def _as_pdf(number: pd.Series, total: pd.Series) -> pd.Series:
    """PDFs whose metadata stand in a deflated stream."""
    bodies = [zlib.compress(f"x /InvoiceNumber({n}) /TotalTax-includedAmount({t})".encode()) for n, t in zip(number, total, strict=True)]
    return pd.Series([b"%PDF-1.7\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + b + b"\nendstream\nendobj" for b in bodies])


def parse_bytes(spark, sf_dir):
    """Orders as files: containers, broken ones, and PDFs with metadata, by key."""
    i = synth.invoices(spark, sf_dir)
    total = synth.cents_text(F.col("net") + F.col("tax"))
    content = F.when(F.col("k") % 2 == 0, _as_pdf(synth.number(), total)).otherwise(_as_ofd(synth.number(), total))
    parsed = parse_documents(i.select("k", content.alias("content")))
    return parsed.select("k", "format", "code", F.col("data.document_type").alias("document_type"), F.col("data.invoice_number").alias("invoice_number"),
                         F.col("data.amount_with_tax").alias("gross"))


def _text_of(content: bytes) -> str:
    """A text layer that fails for every third file."""
    key = int(content[6:])
    if key % 3 == 0:
        raise RuntimeError("unreadable")
    return f"a readable text of no layout at all, {key}"


def failing_functions(spark, sf_dir):
    """Files whose text layer cannot be read: errors of their rows."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    docs = o.select("k", F.concat(F.lit("%PDF-\n"), F.col("k").cast("string")).cast("binary").alias("content"))
    parsed = parse_documents(docs, text_layer=_text_of)
    return parsed.select("k", "status", "code", http_status(F.col("code")).alias("http_status"))


def _reader(share: int):
    def read(content: bytes) -> str:
        text = content.decode()
        if len(text) % share == 0:
            raise ValueError("blurred")
        return text

    return lambda: read


def calibration(spark, sf_dir):
    """Two models that read rail tickets given as bytes; one fails on texts of some lengths, one never."""
    docs = synth.rendered(spark, sf_dir, "rail").select(F.col("k").cast("string").alias("stem"), F.col("text").cast("binary").alias("content"))
    docs = saved(docs, "tickets")
    read = recognised(docs, "never", _reader(10**9)).unionByName(recognised(docs, "some", _reader(2))).unionByName(recognised(docs, "right", _reader(10**9)))
    records = saved(calibrated(read), "calibrated")
    expected = records.where("model = 'right'").select("stem", "data")
    return model_summary(with_matches(records.where("model <> 'right'"), expected, "stem")).select("model", "total", (F.col("ok") + F.col("failed")).alias("all_read"), (F.col("ok") - F.col("parse_ok")).alias("lost"),
                                                            (F.col("match_invoice_number") - F.col("parse_ok")).alias("wrong_numbers"), (F.col("failed") > 0).alias("some_failed"))


def glyph_line_boxes(spark, sf_dir):
    """Glyphs laid out from order lines: box, font size and text of each line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    chars = lines.select("l_orderkey", "l_linenumber", F.posexplode(F.split(F.col("p").cast("string"), "")).alias("position", "char")).where("char <> ''")
    x0 = F.col("position") * 6.0
    glyphs = chars.withColumns({"x0": x0, "x1": x0 + 5.0, "y0": F.col("l_linenumber") * 12.0, "y1": F.col("l_linenumber") * 12.0 + 8.0 + F.col("char").cast("int") % 2})
    return line_boxes(glyphs, ["l_orderkey", "l_linenumber"])


def stream_batch_equivalence(spark, sf_dir):
    """Texts parsed as a stream of files and as a batch; one row with both counts and their agreement. Its files go when it ends."""
    local = spark.sparkContext.master.startswith("local[")
    folder = tempfile.mkdtemp(prefix="quillspark-stream-") if local else f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"
    docs = synth.rendered(spark, sf_dir, "special")
    docs.write.parquet(f"{folder}/in")
    batch = parse_documents(spark.read.parquet(f"{folder}/in")).select("k", "status", "data.invoice_number", "data.amount_with_tax")
    batch.write.parquet(f"{folder}/batch")  # compared twice, parsed once
    batch = spark.read.parquet(f"{folder}/batch")
    parse_stream(spark.readStream.schema("k long, text string").parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    stream = spark.read.parquet(f"{folder}/out").select("k", "status", "data.invoice_number", "data.amount_with_tax")
    counts = [x.count() for x in (batch.exceptAll(stream), stream.exceptAll(batch), stream)]
    if local:
        shutil.rmtree(folder, ignore_errors=True)
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame([tuple(counts)], "only_batch long, only_stream long, n long")


QUERIES = [
    parse_general_fields, parse_tax_free, parse_special, parse_stacked_layout, parse_toll, parse_items_exploded, parse_rail, parse_air_text, parse_air_fields,
    parse_qr, parse_metadata, money_normalize, date_normalize, detect_format, quality_gate, layout_router, envelope_errors, batch_totals, field_accuracy,
    model_accuracy, pseudonymize, url_allow_list, glyph_line_boxes, stream_batch_equivalence, rate_ties, ocr_answers, model_profiles, capability_rows,
    parse_key_values, parse_bytes, failing_functions, calibration]
_MATCHES = [f.replace(".", "_") for f in FIELDS]

_ROUTED = "CASE doc_id % 8 WHEN 0 THEN 'air' WHEN 1 THEN 'air' WHEN 2 THEN 'rail' WHEN 3 THEN 'special' WHEN 4 THEN 'general' WHEN 5 THEN 'general' END"
_CODE = """CASE k % 8 WHEN 1 THEN 'not_implemented' WHEN 2 THEN 'not_implemented' WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'unsupported_format'
  WHEN 5 THEN 'invalid_input' WHEN 6 THEN 'rule_unhandled' WHEN 7 THEN 'parse_failed' END"""
_T = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'e' || chr(1) || chr(2)) ELSE text END || CASE WHEN doc_id % 7 = 0 THEN '发票' ELSE '' END"

SQL = {
    "parse_general_fields": _field_sql(),
    "parse_tax_free": _field_sql(tax="NULL", gross="net"),
    "parse_special": _field_sql("digital_special"),
    "parse_stacked_layout": _field_sql(),
    "parse_toll": _field_sql(net="fc", tax="fx", gross="fc + fx", n="1", base=FIRST_LINE, table="b1").replace(
        "issued AS issue_date", "strftime(day + INTERVAL 30 YEAR, '%Y-%m-%d') AS issue_date"),
    "parse_items_exploded": BASE + f"""SELECT i.k, '*商品*' || CASE WHEN p % 2 = 1 THEN ' ' ELSE '' END || 'P' || p AS item_name, {_cents('c')} AS item_amount,
      r || '%' AS item_tax_rate, {_cents('x')} AS item_tax_amount FROM i JOIN b ON b.k = i.k""",
    "parse_rail": BASE + f"""SELECT k, 'pdf-rail-12306' AS document_type, number AS invoice_number, issued AS issue_date, buyer, {_cents('net')} AS gross,
      '电子客票号:E' || k AS remark, '张三' AS passenger_name, '110000********' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS id_no_masked,
      'G' || lpad(CAST(k % 9000 + 100 AS VARCHAR), 4, '0') AS train_no, '甲' || cust AS from_station, '乙' || s AS to_station,
      issued || ' 08:15:00' AS depart_time, '二等座' AS seat_type FROM b""",
    "parse_air_text": BASE + f"""SELECT k, 'image-air-itinerary' AS document_type, number AS invoice_number, issued AS issue_date, buyer, {_cents('net')} AS net,
      {_cents('tax')} AS tax, {_cents('net + tax')} AS gross, true AS ocr_used, '李四' AS passenger_name, 'CA' || (k % 9000 + 1000) AS flight_no,
      '甲' || cust AS from_station, '乙' || s AS to_station, issued || ' 08:15:00' AS depart_time, '0.09' AS tax_rate,
      '78' || lpad(CAST(k AS VARCHAR), 11, '0') AS e_ticket_number FROM b""",
    "parse_air_fields": BASE + f"""SELECT k, 'ofd-air-itinerary' AS document_type, number AS invoice_number, buyer, {_cents('net + tax')} AS gross,
      '电子客票号:' || lpad(CAST(k AS VARCHAR), 13, '7') || '；签注:不得签转' AS remark, issued || ' 08:15:00' AS depart_time, '0.09' AS tax_rate FROM b""",
    "parse_qr": BASE + f"""SELECT k, number AS invoice_number, '0330' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') AS invoice_code, issued AS issue_date,
      {_cents('net')} AS amount_with_tax, 'C' || lpad(CAST(cust AS VARCHAR), 19, '0') AS checksum, 'qrcode' AS extracted_by FROM b""",
    "parse_metadata": _field_sql(n="0").replace("issued AS issue_date", "strftime(day + INTERVAL 30 YEAR, '%Y-%m-%d') AS issue_date"),
    "money_normalize": """WITH m AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_partkey % 10 AS m FROM lineitem),
      c AS (SELECT *, m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END AS c FROM m)
      SELECT l_orderkey, l_linenumber, '¥ ' || format('{:,}', m // 1000) || '.' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') AS raw,
      (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS normal FROM c""",
    "date_normalize": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS normal FROM orders",
    "detect_format": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'image' WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN 'pdf'
      WHEN doc_id % 8 BETWEEN 1 AND 5 THEN 'image' WHEN doc_id % 16 = 6 THEN 'ofd' ELSE 'unknown' END AS format FROM documents""",
    "quality_gate": f"""WITH t AS (SELECT doc_id, regexp_replace({_T}, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
      n AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}¥￥.:：,，()（）%\\-_*]', '', 'g')) AS m,
      length(regexp_replace(t, '[^\\x00-\\x1f]', '', 'g')) AS c, contains(t, '发票') AS inv FROM t)
      SELECT doc_id, n < 20 OR m / n < 0.35 OR c / n > 0.25 OR (NOT inv AND c / n > 0.1) AS unusable FROM n""",
    "layout_router": f"SELECT doc_id, {_ROUTED} AS layout FROM documents",
    "envelope_errors": BASE + f"""SELECT k, CASE WHEN k % 8 = 0 THEN 'ok' ELSE 'error' END AS status, {_CODE} AS code,
      CAST(CASE k % 8 WHEN 0 THEN 200 WHEN 1 THEN 501 WHEN 2 THEN 501 WHEN 3 THEN 415 WHEN 4 THEN 415 WHEN 5 THEN 400 ELSE 422 END AS INT) AS http_status,
      CASE k % 8 WHEN 0 THEN 'pdf-fapiao' WHEN 2 THEN 'ofd-fapiao' WHEN 6 THEN 'pdf-fapiao' END AS document_type, k % 8 IN (1, 6) AS ocr_required FROM b""",
    "batch_totals": BASE + "SELECT count(*) AS total, count(*) FILTER (WHERE k % 8 = 0) AS succeeded, count(*) FILTER (WHERE k % 8 <> 0) AS failed FROM b",
    "field_accuracy": BASE + "SELECT k, " + ", ".join(
        {"invoice_number": "k % 5 <> 0 AS invoice_number", "buyer_name": "k % 7 <> 0 AS buyer_name"}.get(f, f"true AS {f}") for f in _MATCHES) + " FROM b",
    "model_accuracy": BASE + """SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS model, count(*) AS total, count(*) FILTER (WHERE k % 3 <> 0) AS ok,
      count(*) FILTER (WHERE k % 3 = 0) AS failed, count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 <> 0) AS parse_ok,
      count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 = 0) AS parse_failed, round(avg((k % 10) / 4.0), 3) AS avg_elapsed_seconds,
      """ + ", ".join(f"count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 <> 0{ {'invoice_number': ' AND k % 5 <> 0', 'buyer_name': ' AND k % 7 <> 0'}.get(f, '')}) AS match_{f}"
                      for f in _MATCHES) + " FROM b GROUP BY 1",
    "pseudonymize": """WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1), n AS (SELECT c, row_number() OVER (ORDER BY k) AS n FROM f)
      SELECT '客户' || c || '科技有限公司' AS value, n, '脱敏主体' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '有限公司' AS token FROM n""",
    "url_allow_list": "SELECT page_id, coalesce(starts_with(url, 'https://'), false) AS allowed, page_id % 11 IN (7, 8) AS host_allowed FROM pages",
    "rate_ties": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS r FROM lineitem),
      c AS (SELECT *, r // 10 + CASE WHEN r % 10 > 5 OR (r % 10 = 5 AND (r // 10) % 2 = 1) THEN 1 ELSE 0 END AS c FROM r)
      SELECT l_orderkey, l_linenumber, (r // 10) || '.' || (r % 10) || '%' AS rate, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS share FROM c""",
    "ocr_answers": """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '号码 ' || o_orderkey || chr(10) || '客户 ' || o_custkey WHEN 1 THEN '号码 ' || o_orderkey || chr(10) || '客户 ' || o_custkey
      WHEN 2 THEN '号码: ' || o_orderkey || chr(10) || '客户 ' || o_custkey WHEN 3 THEN '号码: ' || o_orderkey || chr(10) || '客户: ' || o_custkey
      WHEN 4 THEN o_orderkey || chr(10) || o_custkey END AS text FROM orders""",
    "model_profiles": """SELECT c_custkey, CASE c_custkey % 7 WHEN 3 THEN 'scene-lite' WHEN 4 THEN NULL WHEN 6 THEN 'mobile-lite' ELSE 'invoice-lite' END AS profile FROM customer""",
    "capability_rows": """SELECT * FROM (VALUES ('format', 'pdf', 'supported'), ('format', 'ofd', 'partial_supported'), ('format', 'image', 'supported'),
      ('document_type', 'pdf-fapiao', 'supported'), ('document_type', 'pdf-rail-12306', 'supported'), ('document_type', 'ofd-air-itinerary', 'supported'),
      ('document_type', 'image-air-itinerary', 'supported'), ('document_type', 'ofd-fapiao', 'supported'), ('document_type', 'image-fapiao', 'supported'),
      ('invoice_type', 'digital_general', 'supported'), ('invoice_type', 'digital_special', 'supported'), ('invoice_type', 'rail_12306', 'supported'),
      ('invoice_type', 'air_itinerary', 'supported'), ('ocr_mode', 'auto', 'supported'), ('ocr_mode', 'disabled', 'supported'), ('ocr_mode', 'required', 'supported')
      ) AS t(kind, name, status)""",
    "parse_key_values": BASE + f"""SELECT k, number AS invoice_number, {_cents('net + tax')} AS gross, '不得退票' AS remark, '王五' AS passenger_name, 'CA' || k AS flight_no,
      '某航' AS carrier, issued || ' 09:30:00' AS depart_time, {_cents('net')} AS fare, '0.12' AS tax_rate FROM b""",
    "parse_bytes": BASE + f"""SELECT k, CASE WHEN k % 2 = 0 THEN 'pdf' WHEN k % 7 = 0 THEN 'unknown' ELSE 'ofd' END AS format,
      CASE WHEN k % 2 = 1 AND k % 7 = 0 THEN 'unsupported_format' END AS code,
      CASE WHEN k % 2 = 0 THEN 'pdf-fapiao' WHEN k % 7 <> 0 THEN 'ofd-air-itinerary' END AS document_type,
      CASE WHEN k % 2 = 0 OR k % 7 <> 0 THEN number END AS invoice_number, CASE WHEN k % 2 = 0 OR k % 7 <> 0 THEN {_cents('net + tax')} END AS gross FROM b""",
    "failing_functions": """SELECT o_orderkey AS k, 'error' AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'internal_error' ELSE 'parse_failed' END AS code,
      CAST(CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE 422 END AS INT) AS http_status FROM orders""",
    "calibration": BASE + """SELECT model, count(*) AS total, count(*) AS all_read, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS wrong_numbers, model = 'some' AS some_failed
      FROM b, (VALUES ('never'), ('some')) AS m(model) GROUP BY model""",
    "glyph_line_boxes": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_partkey) AS VARCHAR) AS t FROM lineitem GROUP BY 1, 2),
      c AS (SELECT *, unnest(range(length(t))) AS i FROM l), g AS (SELECT *, CAST(substr(t, i + 1, 1) AS INT) % 2 AS odd FROM c)
      SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS x0, CAST(l_linenumber * 12.0 AS DOUBLE) AS y0, CAST((length(any_value(t)) - 1) * 6.0 + 5.0 AS DOUBLE) AS x1,
      CAST(l_linenumber * 12.0 + 8.0 + max(odd) AS DOUBLE) AS y1, CAST(8.0 + median(odd) AS DOUBLE) AS font_size, any_value(t) AS text FROM g GROUP BY 1, 2""",
    "stream_batch_equivalence": "SELECT CAST(0 AS BIGINT) AS only_batch, CAST(0 AS BIGINT) AS only_stream, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}


def queries() -> dict:
    return {q.__name__: q for q in QUERIES + queries_records.QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL | queries_records.SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_general_fields(spark, sf_dir)
