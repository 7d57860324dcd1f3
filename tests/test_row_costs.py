"""What an expression does anew for every row."""

from pyspark.sql import functions as F

from quillspark.functions.text import first_of, let, not_empty
from quillspark.operators import invoice_fields
from quillspark.operators.invoice_items import tail


def test_types_are_told_once(spark):
    """``get`` on an array that an expression makes derives that expression's type for every row."""
    t = F.col("t")
    for made in (let(F.upper(t), lambda x: F.concat(x, x)), first_of(F.array(t)), not_empty(t)):
        assert made._jc.toString().startswith("element_at(transform(")
    df = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    got = df.select(let(F.upper(t), lambda x: F.concat(x, x)), first_of(F.array(F.lit(None), t)), not_empty(t)).collect()
    assert [tuple(r) for r in got] == [("AA", "a", "a"), ("", "", None), (None, None, None)]


def test_patterns_are_compiled_once(spark):
    """``split`` compiles its pattern for every row."""
    t = F.col("t")
    for made in (invoice_fields._labelled_names(t), invoice_fields._tax_ids(t)):
        assert "split(" not in made._jc.toString()
    text = "名 称: 甲乙丙公司 名\t称:丁戊己公司 销售\n名称: x\n名称:庚辛壬公司 购买方\n统一社会信用代码/纳 税人识别号: 91110000123456789A 纳税人识别号：B11100001234567"
    got = spark.createDataFrame([(text,)], "t string").select(invoice_fields._labelled_names(t).alias("names"), invoice_fields._tax_ids(t).alias("ids")).first()
    assert got.names == ["甲乙丙公司", "丁戊己公司", "庚辛壬公司"] and got.ids == ["91110000123456789A", "B11100001234567"]


def test_lines_that_end_no_item_are_not_cut(spark):
    df = spark.createDataFrame([("开票人: 王五",), ("a 1.00 免税",), ("a 1.00 13% 0.13",), ("a 1.00 免税 ＊",), ("",)], "t string")
    got = [r.x for r in df.select(tail(F.col("t")).alias("x")).collect()]
    assert [x.words for x in got] == [None, ["a", "1.00", "免税"], ["a", "1.00", "13%", "0.13"], ["a", "1.00", "免税", "＊"], None]
    assert [(x.taxed, x.free, x.starred) for x in got] == [(False,) * 3, (False, True, False), (True, False, False), (False, False, True), (False,) * 3]
