"""A parse with a text layer opens containers and reads texts in one Python process a task."""

import itertools

import pytest

from quillspark.plans.parse import parse_documents
from quillspark.queries import failing_functions

HEADS = [b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff", b"junk", b"", None]


def _passes(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython")


def test_failing_functions_has_two_python_stages(spark):
    assert _passes(failing_functions(spark, "/root/testdata/sf0.001")) == 2


@pytest.mark.parametrize("given", ["content", "content and text"])
def test_same_rows_as_in_two_passes(spark, given):
    def layer(content: bytes) -> str:
        if content.endswith(b"!"):
            raise ValueError("unreadable")
        return f"a readable text of no layout at all, {len(content)}"

    rows = [
        (i, None if c is None else bytearray(c + more), text, hint, mode)
        for i, (c, more, text, hint, mode) in enumerate(itertools.product(
            HEADS, (b"", b"!", b"x" * 40), (None, "a text that was given"), (None, "pdf", "ofd", "odd"), (None, "disabled", "odd")))]
    df = spark.createDataFrame(rows, "i int, content binary, text string, hint_type string, ocr_mode string").coalesce(2)
    df = df.drop("text") if given == "content" else df
    once = parse_documents(df, text_layer=layer, max_bytes=30)
    # without file names an extension tells nothing, and texts are read in a pass of their own
    twice = parse_documents(df.selectExpr("*", "CAST(NULL AS STRING) AS filename"), text_layer=layer, max_bytes=30, trust_extension=True)
    assert _passes(once) == _passes(twice) - 1
    shown = ["i", "status", "code", "message", "document_type", "to_json(engine)"]
    assert sorted(map(str, once.selectExpr(*shown).collect())) == sorted(map(str, twice.selectExpr(*shown).collect()))
    codes = {r["code"] for r in once.select("code").collect()}
    assert {"internal_error", "parse_failed", "invalid_input", "unsupported_format"} <= codes
