"""Departures, addresses, whole sums: cases that were wrong before. Pseudonyms in whole records."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.invoice_fields import totals
from quillspark.functions.text import filled_lines, lines
from quillspark.operators.pseudonyms import FIELDS, field_mentions, pseudonymized, replaced_everywhere, rewriter, text_mentions, token_table, values_in
from quillspark.operators.rail import _departure
from quillspark.operators.urls import url_allowed
from quillspark.sources.scratch import saved

RND = random.Random(3)


@pytest.mark.parametrize("text,time,seat", [
    ("2026年01月02日 08:15开 晚点\n2026年01月03日 09:15开 二等座", "2026-01-03 09:15:00", "二等座"),
    ("2026年01月02日 08:15开 检票口1 一等软座", "2026-01-02 08:15:00", "一等软座"),
    ("2026年1月2日 8:15开 05车10A号\n\n 二等座 x", "2026-01-02 08:15:00", "二等座"),
    ("2026年01月02日 08:15开 晚点 2026年01月03日 09:15开 硬卧座", "2026-01-02 08:15:00", "硬卧座"),
    ("2026年01月02日 08:15开二等座", None, None),
    ("2026年01月02日 08:15开\nx 二等座", None, None),
])
def test_departures(spark, text, time, seat):
    got = spark.createDataFrame([(text,)], "t string").select(_departure(F.col("t")).alias("d")).first()["d"]
    assert (got["time"], got["seat"]) == (time, seat) if time else got is None


def test_addresses_like_the_library(spark):
    hosts = ["[100:1::1]", "[1ff::1]", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.100", "8.8.8.8", "[2001:4860::8888]", "[2001:3::1]", "[2001:1::1]", "[2001:1::3]"]
    hosts += [str(ipaddress.IPv4Address(RND.getrandbits(32))) for _ in range(100)] + [f"[{ipaddress.IPv6Address(RND.getrandbits(128) >> RND.choice([0, 3, 8, 64]))}]" for _ in range(200)]
    hosts += [str(n[i]) for n in map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "198.18.0.0/15")) for i in (0, -1)]

    def fine(host):
        a = ipaddress.ip_address(host.strip("[]"))
        return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

    rows = spark.createDataFrame([(h, f"https://{h}/x") for h in hosts], "h string, u string")
    for r in rows.select("h", url_allowed(F.col("u")).alias("ok")).collect():
        assert r["ok"] == fine(r["h"]), r["h"]


@pytest.mark.parametrize("url", ["https://\t127.0.0.1/", "https://10.0.0.1\t/", "https://１２７.0.0.1/", "https://127。0。0。1/", " https://local\nhost/", "https://ｌocalhost/"])
def test_disguised_addresses(spark, url):
    assert not spark.createDataFrame([(url,)], "u string").select(url_allowed(F.col("u")).alias("ok")).first()["ok"]


def test_sums_far_behind_their_label(spark):
    text = "合 计" + " " * 300 + "¥100.00 ¥6.00\nend"
    row = spark.createDataFrame([(text,)], "t string").select(totals(F.col("t"), filled_lines(lines(F.col("t")))).alias("x")).first()["x"]
    assert (row["first"], row["second"]) == ("100.00", "6.00")


@pytest.mark.parametrize("text,values", [
    ("2026年01月01日和", [("date", "2026年01月01日")]), ("2024-01-02 x", [("date", "2024-01-02")]), ("2024 / 1 / 2", [("date", "2024 / 1 / 2")]), ("1999-01-02", []),
    ("税号91310000MA1FL0XX3K,", [("tax", "91310000MA1FL0XX3K")]), ("x20240305", [("number", "20240305")]), ("20240305", [("compact_date", "20240305")]),
    ("110101********1234", [("id", "110101********1234")]), ("1101011990****1234", [("id", "1101011990****1234")]), ("号码1234567", []), ("E12345678", [("number", "12345678")]),
    ("1.12345678", []), ("¥ -12.505", [("money", "¥ -12.50")]), ("CNY 9.00 Y3. 5", [("money", "CNY 9.00"), ("money", "Y3. 5")]), ("xCNY 9.00", [("money", "Y 9.00")]),
    ("向甲方（上海）有限公司付款", [("company", "向甲方（上海）有限公司")]), ("公司", []), ("甲" * 60 + "公司", [("company", "甲" * 40 + "公司")]), ("", []),
])
def test_values_in_texts(text, values):
    assert [(c, text[a:b]) for c, a, b in values_in(text)] == values


def test_longer_values_first():
    rewrite = rewriter([("ab", "1"), ("abc", "2"), ("bcd", "3"), ("1", "x"), ("", "y"), ("ab", "later")])
    assert rewrite("abcd ab 1 bcd") == "2d 1 x 3" and rewrite("") == ""

    def plain(text, pairs):
        taken, out = [None] * len(text), {}
        for v, t in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
            for i in range(len(text) - len(v) + 1):
                if text[i : i + len(v)] == v and not any(taken[i : i + len(v)]):
                    taken[i : i + len(v)], out[i] = [True] * len(v), (len(v), t)
        i, said = 0, []
        while i < len(text):
            n, t = out.get(i, (1, text[i]))
            said.append(t)
            i += n
        return "".join(said)

    for _ in range(300):
        pairs = list({"".join(RND.choices("ab", k=RND.randint(1, 4))): str(i) for i in range(4)}.items())
        text = "".join(RND.choices("abc", k=20))
        assert rewriter(pairs)(text) == plain(text, pairs)


RECORD = ("doc_id long, data struct<buyer:struct<name:string,tax_id:string>,people:array<struct<passenger_name:string,age:int>>,more:map<string,string>,"
          "deep:map<string,struct<invoice_number:string>>,day:date>, text string, n int")


def test_whole_records(spark):
    rows = [(1, (("甲有限公司", "91310000MA1FL0XX3K"), [("张三", 3), (None, None)], {"Buyer": "乙公司", "x": "张三 丙"}, {"张三": ("123", )}, None), "张三 of 甲有限公司", 5),
            (2, ((None, "OK"), [], {}, None, None), "张三", 6), (None, None, None, None), (3, (("甲有限公司", ""), None, None, None, None), "", 7)]
    records = spark.createDataFrame(rows + rows[-1:], RECORD)
    mentions = field_mentions(records)
    found = sorted((r["doc_id"], r["position"], r["category"], r["value"]) for r in mentions.collect())
    assert [(i, c, v) for i, _, c, v in found] == [(1, "company", "甲有限公司"), (1, "tax", "91310000MA1FL0XX3K"), (1, "person", "张三"), (1, "company", "乙公司"), (1, "code", "123"),
                                                  (3, "company", "甲有限公司"), (3, "company", "甲有限公司")]
    out = pseudonymized(records, token_table(mentions), mentions)
    assert out.schema == records.schema
    got = sorted(out.collect(), key=str)
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["text"] == "测试人员001 of 脱敏主体001有限公司" and one["n"] == 5 and one["data"]["buyer"]["tax_id"] == "9111000000000001A"
    assert one["data"]["people"] == [("测试人员001", 3), (None, None)] and one["data"]["more"] == {"Buyer": "脱敏主体002公司", "x": "测试人员001 丙"}
    assert list(one["data"]["deep"].items()) == [("张三", (f"{1:020d}",))]
    assert next(r for r in got if r["doc_id"] == 2)["text"] == "张三" and len(got) == 5  # its own document does not name him
    assert field_mentions(records.select("doc_id", "text")).count() == 0 and pseudonymized(records.limit(0), token_table(mentions), mentions).count() == 0
    assert "Exchange" not in field_mentions(records, fields=FIELDS)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 100])
def test_everywhere_by_slices(spark, size):
    tokens = spark.createDataFrame([("ab", "<x>"), ("abc", "<ab>"), ("x", "<y>"), ("zz", "<q>"), ("yy", "<r>"), (None, "n"), ("", "e")], "value string, token string")
    records = spark.createDataFrame([(1, "abc ab x zzyy", ["ab"]), (2, None, None)], "k long, t string, l array<string>")
    out = {r["k"]: (r["t"], r["l"]) for r in replaced_everywhere(records, tokens, ["t", "l"], saved, size).collect()}
    assert out == {1: ("<ab> <x> <y> <q><r>", ["<x>"]), 2: (None, None)}
