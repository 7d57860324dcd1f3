"""Renders documents from order tables, so that parsing can be checked against the tables themselves.

One document an order: the order gives number and date, its customer the buyer, the least supplier of its lines the
seller, its lines the items. Sums are whole cents. Keys decide widths, line ends and line breaks, so layouts vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def cents_text(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, cust, supp, day, net, tax, rows): one row an order that has lines; rows by all their values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.round(F.col("l_tax") * 100).cast("long").alias("rate"))
    lines = lines.withColumn("tax", F.floor((F.col("cents") * F.col("rate") + 50) / 100))
    rows = F.array_sort(F.collect_list(F.struct("p", "cents", "rate", "tax")))
    by_order = lines.groupBy("k").agg(F.min("s").alias("supp"), F.sum("cents").alias("net"), F.sum("tax").alias("tax"), rows.alias("rows"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("day"))
    # rendering and parsing are work for all cores, however few bytes the rows have here
    return by_order.join(orders, "k").repartition(2 * spark.sparkContext.defaultParallelism, "k")


def number() -> Column:
    return F.concat(F.lit("26"), F.lpad(F.col("k").cast("string"), 12, "0"), F.lpad(F.col("supp").cast("string"), 6, "0"))


def buyer() -> Column:
    return F.concat(F.lit("客户"), F.col("cust").cast("string"), F.lit("科技有限公司"))


def seller() -> Column:
    return F.concat(F.lit("供应"), F.col("supp").cast("string"), F.lit("贸易有限公司"))


def buyer_id() -> Column:
    return F.concat(F.lit("9111"), F.lpad(F.col("cust").cast("string"), 13, "0"), F.lit("A"))


def seller_id() -> Column:
    return F.concat(F.lit("9222"), F.lpad(F.col("supp").cast("string"), 13, "0"), F.lit("B"))


def day_text() -> Column:
    return F.date_format("day", "yyyy年MM月dd日")


class _Rows:
    """Marks a column that is an array of lines."""

    def __init__(self, column: Column):
        self.column = column


def _col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def _text(parts: list, widths: bool = True) -> Column:
    """Lines in Unix or DOS form, with half- or (if ``widths``) full-width signs, as the key decides."""
    arrays = [p.column if isinstance(p, _Rows) else F.array(_col(p)) for p in parts]
    text = F.array_join(F.concat(*arrays), "\n")
    text = F.when(F.col("k") % 2 == 0, F.regexp_replace(text, "\n", "\r\n")).otherwise(text)
    return F.when(F.col("k") % 3 == 0, F.translate(text, ":()", "：（）")).otherwise(text) if widths else text


HEAD = "项目名称 规格型号 单位 数量 单价 金额 税率/征收率 税额"


def _items(free: bool = False) -> _Rows:
    """A line an item; for odd parts the name starts on a line of its own."""
    def one(x: Column) -> Column:
        tail = F.concat(F.lit("P"), x["p"].cast("string"), F.lit(" "), cents_text(x["cents"]), F.lit(" "))
        tail = F.concat(tail, F.lit("免税 *")) if free else F.concat(tail, x["rate"].cast("string"), F.lit("% "), cents_text(x["tax"]))
        return F.when(x["p"] % 2 == 1, F.array(F.lit("*商品*"), tail)).otherwise(F.array(F.concat(F.lit("*商品*"), tail)))

    return _Rows(F.flatten(F.transform("rows", one)))


def _yuan(cents: Column) -> Column:
    return F.concat(F.lit("¥"), cents_text(cents))


def general(free: bool = False) -> Column:
    net, tax = F.col("net"), F.col("tax")
    gross = net if free else net + tax
    total = F.concat(F.lit("合 计 "), _yuan(net), F.lit(" *") if free else F.concat(F.lit(" "), _yuan(tax)))
    return _text([
        "电子发票(普通发票)", F.concat(F.lit("发票号码: "), number()), F.concat(F.lit("开票日期: "), day_text()), "购买方信息 销售方信息",
        F.concat(F.lit("名 称: "), buyer(), F.lit(" 名 称: "), seller()),
        F.concat(F.lit("统一社会信用代码/纳税人识别号: "), buyer_id(), F.lit(" 统一社会信用代码/纳税人识别号: "), seller_id()),
        HEAD, _items(free), total, F.concat(F.lit("价税合计(大写) 壹佰圆整 (小写) "), _yuan(gross)), "开票人: 王五"])


def special() -> Column:
    return _text([
        "电子发票(增值税专用发票)", number(), day_text(), F.concat(buyer(), F.lit(" "), seller()), F.concat(buyer_id(), F.lit(" "), seller_id()), HEAD,
        _items(), "合 计", F.concat(_yuan(F.col("net")), F.lit(" "), _yuan(F.col("tax"))),
        F.concat(F.lit("价税合计(大写) 壹佰圆整 (小写) "), _yuan(F.col("net") + F.col("tax")))])


def stacked() -> Column:
    return _text([
        "电子发票(普通发票) 发票号码:", "开票日期:", "购", "买", "方", "统一社会信用代码/纳税人识别号:", "销", "售", "方", "统一社会信用代码/纳税人识别号:", "名称: 名称:",
        HEAD, "合 计", "价税合计(大写) (小写)", "备注", number(), day_text(), buyer(), buyer_id(), seller(), seller_id(),
        F.concat(_yuan(F.col("net")), F.lit(" "), _yuan(F.col("tax"))), F.concat(F.lit("壹佰圆整 "), _yuan(F.col("net") + F.col("tax"))),
        _items()])


def toll() -> Column:
    """The first line of the order as a toll, over two lines, with everything unlabelled, thirty years later."""
    x = F.col("rows")[0]
    later = F.add_months("day", 360)  # this layout knows years from 2000 on
    day = F.date_format(later, "yyyyMMdd")
    return _text([
        "电子发票(普通发票)", "发票号码:", "开票日期:", "项目名称 车牌号 车辆类型 通行日期起 通行日期止 金额 税率/征收率 税额", "合 计", "价税合计(大写) (小写)",
        F.concat(number(), F.lit(" "), F.date_format(later, "yyyy年MM月dd日"), F.lit(" "), buyer_id()),
        F.concat(seller(), seller_id(), F.lit(" *经营租赁*通行费 浙A00000 客车")),
        F.concat(day, F.lit(" "), cents_text(x["cents"]), F.lit(" "), x["rate"].cast("string"), F.lit("% "), cents_text(x["tax"]), F.lit(" "),
                 _yuan(x["cents"]), F.lit(" 壹佰圆整 王五 "), _yuan(x["cents"] + x["tax"]), F.lit(" "), day, F.lit(" "), buyer(), F.lit(" "), _yuan(x["tax"]))])


def rail() -> Column:
    return _text([
        "中国铁路电子客票", F.concat(F.lit("发票号码:"), number()), F.concat(F.lit("开票日期:"), day_text()),
        F.concat(F.lit("购买方名称:"), buyer(), F.lit(" 统一社会信用代码:"), buyer_id()), F.concat(F.lit("电子客票号:E"), F.col("k").cast("string")),
        "出发站 车次 到达站", F.concat(F.lit("甲"), F.col("cust").cast("string"), F.lit(" G"), F.lpad((F.col("k") % 9000 + 100).cast("string"), 4, "0"), F.lit(" 乙"), F.col("supp").cast("string")),
        F.concat(day_text(), F.lit(" 08:15开 检票口1 二等座")), F.concat(F.lit("110000********"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.lit(" 张三")),
        _yuan(F.col("net"))], widths=False)


def air() -> Column:
    """A recognised itinerary: blocks of labels followed by blocks of values."""
    def cny(cents: Column) -> Column:
        return F.concat(F.lit("CNY "), cents_text(cents))

    net, tax = F.col("net"), F.col("tax")
    return _text([
        "电子发票", "航空运输电子客票行程单", F.concat(F.lit("发票号码:"), number()), "旅客姓名", "有效身份证件号码", "签注", "李四", F.concat(F.lit("110000********"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0")), "不得签转",
        "承运人", "航班号", "座位等级", "日期", "时间", F.concat(F.lit("自:甲"), F.col("cust").cast("string")), "CA", F.concat(F.lit("CA"), (F.col("k") % 9000 + 1000).cast("string")),
        "Y", day_text(), "08:15", "Y", "20K", F.concat(F.lit("至:乙"), F.col("supp").cast("string")), "票价", "燃油附加费", "增值税税率", "增值税税额", "民航发展基金", "其他税费", "合计",
        cny(net), "CNY 9.00", "9%", cny(tax), "CNY 50.00", "CNY 0.00", cny(net + tax), F.concat(F.lit("电子客票号码:78"), F.lpad(F.col("k").cast("string"), 11, "0")),
        "填开单位:某航空服务有限公司", F.concat(F.lit("填开日期:"), day_text()), F.concat(F.lit("购买方名称:"), buyer())], widths=False)


def qr() -> Column:
    return F.concat_ws(",", F.lit("01"), F.lit("32"), F.concat(F.lit("0330"), F.lpad((F.col("k") % 100000000).cast("string"), 8, "0")), number(),
                       cents_text(F.col("net")), F.date_format("day", "yyyyMMdd"), F.concat(F.lit("C"), F.lpad(F.col("cust").cast("string"), 19, "0")))


LAYOUTS = {"general": general, "special": special, "stacked": stacked, "toll": toll, "rail": rail, "air": air}


def rendered(spark: SparkSession, sf_dir: str, layout: str, **options) -> DataFrame:
    """(k, text) of every order in one layout."""
    return invoices(spark, sf_dir).select("k", LAYOUTS[layout](**options).alias("text"))
