"""Which layout a text has, and whether a text layer can be read at all."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.text import compact, contains_any, count_of, let, routing_form, trimmed

# Marker words of the layouts.
INVOICE_MARKERS = ["发票", "价税合计", "货物或应税劳务", "购买方", "销售方", "销货方"]
AIR_TITLES = ["机票行程单", "航空运输电子客票行程单"]
AIR_MARKERS = ["旅客姓名", "有效身份证件号码", "承运人", "航班号", "电子客票号码", "燃油附加费", "民航发展基金", "国内国际标识"]
RAIL_MARKERS = ["电子客票", "中国铁路"]
LEAST_TEXT = 20
CONTROL = r"[\x00-\x1f]+"
# The frequent classes first: a sign is told by the first that holds it.
MEANINGLESS = r"[^一-鿿0-9A-Za-z.:,()%\-_*¥￥：，（）\p{L}\p{N}]++"
# A text without any of these pairs has no title of an itinerary, and three at most of its eight markers.
AIR_SIGNS = "[行旅承航燃民][程客运班油航]"


def looks_like_invoice(text: Column) -> Column:
    return let(compact(text), lambda t: contains_any(t, INVOICE_MARKERS))


def unusable_text(text: Column) -> Column:
    """True for null or short texts, few meaningful characters, or many control characters (line ends are such)."""
    def judged(t: Column) -> Column:
        meaningful = F.length(F.regexp_replace(t, MEANINGLESS, ""))
        size = F.length(t)
        control = size - F.length(F.regexp_replace(t, CONTROL, ""))
        return F.when(size < LEAST_TEXT, True).otherwise(
            (control / size > 0.25) | ((control / size > 0.1) & ~looks_like_invoice(t)) | (meaningful / size < 0.35))

    return let(trimmed(F.coalesce(text, F.lit(""))), judged)


def too_short(text: Column) -> Column:
    return F.length(trimmed(F.coalesce(text, F.lit("")))) < LEAST_TEXT


def is_air(n: Column) -> Column:
    return n.rlike(AIR_SIGNS) & (contains_any(n, AIR_TITLES) | (count_of(n, AIR_MARKERS) >= 4))


def is_general(n: Column) -> Column:
    sums = n.contains("合计")
    plain = n.contains("普通发票") | n.contains("通用(电子)发票") | (n.contains("电子发票") & n.contains("发票号码"))
    read = (n.contains("发票号码") & n.contains("开票日期") & contains_any(n, ["纳税人识别号", "统一社会信用代码"]) & sums
            & contains_any(n, ["项目名称", "税率"]))
    old = (n.contains("发票代码") & n.contains("发票号码") & sums & contains_any(n, ["购买方", "购方", "销售方", "销货方"])
           & contains_any(n, ["货物或应税劳务", "服务名称"]))
    return plain | ((read | old) & ~n.contains("专用发票"))


def layout(text: Column) -> Column:
    """``air``, ``rail``, ``special`` or ``general``, first that fits; null if none does."""
    return let(routing_form(text), lambda n: (
        F.when(is_air(n), "air").when(contains_any(n, RAIL_MARKERS), "rail")
        .when(n.contains("增值税专用发票"), "special").when(is_general(n), "general")))
