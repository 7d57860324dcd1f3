"""Expressions that hold costly parts once, however often they use them."""

from pyspark.sql import functions as F

from quillspark.functions.text import present
from quillspark.operators.invoice_fields import totals
from quillspark.operators.rail import rail


def test_costly_parts_stand_once(spark):
    df = spark.createDataFrame([("a", ["b"])], "t string, f array<string>")

    def told(column):
        return df.select(column.alias("x"))._jdf.queryExecution().analyzed().toJSON()

    assert told(rail(F.col("t"))).count(r"\u2029](?:") <= 1  # the lines of a ticket
    assert told(rail(F.col("t"))).count("StringSplit\"") < 12
    assert told(totals(F.col("t"), F.col("f"))).count("´Y]") < 4  # a text with one sign of yuan
    assert told(present(F.col("t"))).count("RegExpReplace\"") == 1


def test_odd_white_space_and_line_ends(spark):
    from quillspark.functions.text import compact, lines, trimmed, words
    said = ["", " 　\x1c", " a \x1f b\x85\n", "a\r\n\r\nb\r", "\n", "a  \tb", "a" + " " * 3000 + "b "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string")
    t = F.col("t")
    got = [tuple(r)[1:] for r in df.select("i", trimmed(t), compact(t), lines(t), words(t)).orderBy("i").collect()]
    assert [g[0] for g in got] == ["", "", "a \x1f b", "a\r\n\r\nb", "", "a  \tb", said[6][:-1]]
    assert [g[1] for g in got] == ["", "", "ab", "ab", "", "ab", "ab"]
    assert [g[2] for g in got][:6] == [[], [" 　", ""][:1], [" a \x1f b", ""], ["a", "", "b"], [""], ["a  \tb"]]
    assert got[5][3] == ["a", "b"] and got[2][3] == ["", "a", "\x1f", "b", ""]


def test_numbers_by_one_set_of_cuts(spark):
    """Quantiles differ between runs over shuffled rows; groups must be counted and ranked by the same."""
    from quillspark.operators.pseudonyms import token_table
    rows = [(7 * i % 3000, 0, "company", f"v{7 * i % 3000}") for i in range(3000)]
    table = token_table(spark.createDataFrame(rows, "doc_id long, position long, category string, value string").repartition(7), groups=16)
    assert "percentile" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert {r["value"]: r["n"] for r in table.collect()} == {f"v{i}": i + 1 for i in range(3000)}


def test_compared_records_are_parsed_once(spark):
    from quillspark.queries import field_accuracy
    plan = field_accuracy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "regexp" not in plan


def test_streams_that_end_in_a_line_feed():
    import zlib

    from quillspark.sources.documents import pdf_metadata
    for end in (b"\n", b"\r"):
        body = next(b for n in range(256) if (b := zlib.compress(b"/InvoiceNumber(26000000000000000001)" + b"y" * n)).endswith(end))
        for gap in (b"\n", b"\r\n", b""):
            assert pdf_metadata(b"%PDF-1.7\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + body + gap + b"endstream\nendobj") == {"InvoiceNumber": "26000000000000000001"}
