"""Unicode rules of text functions, money, URL safety, comparison, pseudonyms."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.money import date_text, date_value, money, percent, two_decimals
from quillspark.functions.text import compact, group, lines, present, trimmed, whole
from quillspark.operators.comparing import with_matches
from quillspark.operators.payloads import header_map, http_ocr_text
from quillspark.operators.pseudonyms import field_mentions, pseudonymized, replaced_everywhere, text_mentions, token_table, values_in
from quillspark.operators.routing import layout
from quillspark.operators.urls import url_allowed


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_text(spark):
    assert values(spark, ["　a\t\x1c", " ", None], trimmed) == ["a", "", None]
    assert values(spark, [" "], present) == [None]
    assert values(spark, ["a 　b\n"], compact) == ["ab"]
    for t in ["a\nb", "a\r\nb\r", "", "\n", "a b\x85c", "a\n\n"]:
        assert values(spark, [t], lines) == [t.splitlines()]
    assert values(spark, ["发票号码：　26"], lambda t: group(t, r"发票号码[:：\s]*(\d+)")) == ["26"]
    assert values(spark, ["12\n"], lambda t: whole(t, r"\d+")) == [False]


def test_money_and_dates(spark):
    assert values(spark, ["¥1,234.565", "0.125", "0.135", "-3", "*", "", None, "x", "1E+3"], money) == [
        "1234.56", "0.12", "0.14", "-3.00", None, None, None, None, "1000.00"]
    assert values(spark, [" 2024-02-30 ", "2024/01/01", "0000-00-00"], date_text) == ["2024-02-30", None, "0000-00-00"]
    assert values(spark, ["2024-02-30"], date_value) == [None]
    assert values(spark, ["9%", "x%", "0.09", "", "12.5%", "13.5%", "1d%"], percent) == ["0.09", "x%", "0.09", None, "0.12", "0.14", "1d%"]
    assert values(spark, ["0.125", "0.135", "1d", "x", "7"], two_decimals) == ["0.12", "0.14", "1d", "x", "7.00"]


def test_routes(spark):
    assert values(spark, ["电⼦客票", "增值税专用发票", "普通 发票", "旅客姓名承运人航班号", "x"], layout) == ["rail", "special", "general", None, None]


def test_urls(spark):
    bad = ["http://a.com", "ftp://a.com", "https://", "https://localhost./", "https://10.0.0.1", "https://[fe80::1]/", "https://u@127.0.0.1:1/", None, "https://0.0.0.0",
           "https://[0:0:0:0:0:0:0:1]/", "https://[0::1]/", "https://[::7f00:1]/", "https://[::ffff:8.8.8.8]/", "https://[fe80::1%25eth0]/", "https://[1:2:3]/", "https://[::1::]/",
           "https://127.1/", "https://2130706433/", "https://0x7f000001/", "https://[fd12::5]", "https://[::]"]
    assert values(spark, bad, url_allowed) == [False] * len(bad)
    assert values(spark, ["https://8.8.8.8/x", "HTTPS://example.com", "https://[2001:4860:4860::8888]/", "https://1a.com"], url_allowed) == [True] * 4
    assert values(spark, ["http://a.com"], lambda u: url_allowed(u, True)) == [True]


def test_ocr_payloads(spark):
    got = values(spark, ['{"text":" a \\n\\n b"}', '{"lines":[{"text":" x "},{"text":""},{"score":1}]}', "{}"], http_ocr_text)
    assert got == ["a\nb", "x", None]
    assert values(spark, ["a: 1; b:2;;c; a:3:4"], header_map) == [{"a": "3:4", "b": "2"}]


def test_nulls_match(spark):
    party = "struct<name:string,tax_id:string>"
    schema = ("k int, data struct<document_type:string,invoice_type:string,invoice_number:string,invoice_code:string,issue_date:string,"
              f"amount_without_tax:string,tax_amount:string,amount_with_tax:string,buyer:{party},seller:{party}>")
    one = spark.createDataFrame([(1, ("a", None, "1", None, None, None, None, None, (None, None), ("s", None)))], schema)
    two = spark.createDataFrame([(1, ("b", None, "1", None, None, None, None, None, (None, None), (None, None)))], schema)
    m = with_matches(one, two, "k").first()["matches"]
    assert not m["document_type"] and m["invoice_type"] and m["invoice_number"] and not m["seller_name"] and m["buyer_name"]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(1, "乙方商店 甲方有限公司"), (2, "甲方有限公司 x"), (3, None)], "doc_id long, text string")
    mentions = text_mentions(docs)
    out = {r["doc_id"]: r["text"] for r in pseudonymized(docs, token_table(mentions), mentions).collect()}
    assert out == {1: "脱敏主体001有限公司 脱敏主体002有限公司", 2: "脱敏主体002有限公司 x", 3: None}


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"order-{i:09d}", lambda i: "ab"[i % 2] * (i % 7 + 1) + str(i)])
@pytest.mark.parametrize("groups", [1, 3, 256])
def test_tokens_follow_first_mention(spark, name, groups):
    """By brute force: ids far apart, strings alike in front, null ids, ties, values mentioned again, categories of unlike size."""
    rows = [(name(i * i), p, "ab"[i % 5 == 0], f"v{i * 7 % 90}") for i in range(200) for p in (1, 2)] + [(None, 1, "a", "v3"), (None, 1, "a", "none")]
    kind = "long" if isinstance(name(0), int) else "string"
    mentions = spark.createDataFrame(rows, f"doc_id {kind}, position int, category string, value string")
    got = {(r["category"], r["value"]): r["n"] for r in token_table(mentions, groups=groups).collect()}
    first = {}
    for key, p, c, v in rows:
        place = (key is not None, key if key is not None else name(0), p)
        first[c, v] = min(first.get((c, v), place), place)
    for c in "ab":
        ranked = sorted((place, v) for (k, v), place in first.items() if k == c)
        assert [got[c, v] for _, v in ranked] == list(range(1, len(ranked) + 1))
    assert len(got) == len(first)
    assert token_table(mentions.limit(0), groups=groups).count() == 0


def test_pseudonyms_of_all_categories(spark):
    text = "开票日期2024年03月05日 税号91310000MA1FL0XX3K 号码24317000000012345678901 金额¥12.50 CNY 9.00 证件110101********1234 20240305 甲方有限公司"
    docs = spark.createDataFrame([(1, text), (2, "2026年01月01日 税号91310000MA1FL0XX3K"), (3, None)], "doc_id long, text string")
    mentions = text_mentions(docs)
    out = {r["doc_id"]: r["text"] for r in pseudonymized(docs, token_table(mentions), mentions).collect()}
    assert out == {
        1: "开票日期2026年01月01日 税号9111000000000001A 号码00000000000000000000001 金额¥107.13 CNY 114.26 证件110000********0001 20260101 脱敏主体001有限公司",
        2: "2026年01月02日 税号9111000000000001A", 3: None}
