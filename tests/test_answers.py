"""Answers of OCR services: each shape, odd ones, random ones against a plain walk, and no Python in the plan."""

import json
import random

import pytest

from quillspark.operators.answers import answer_lines, with_answer_text

RND = random.Random(12)


def lines(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    return [r["l"] for r in df.select("i", answer_lines("a").alias("l")).orderBy("i").collect()]


@pytest.mark.parametrize("answer,told", [
    (None, None), ("", None), ("no json", None), ("[1]", None), ('"x"', None), ("{}", None), ('{"text": " a \\n\\nb "}', ["a", "b"]), ('{"text": ""}', []), ('{"text": 3, "name": "n"}', ["n"]),
    ('{"lines": [{"text": " x "}, 7, {"text": ""}, {"score": 1}, {"text": "y"}]}', ["x", "y"]), ('{"lines": []}', []), ('{"lines": 3}', None),
    ('{"Response": {"MixedInvoiceItems": [{"Name": "n", "Value": "v"}, {"OcrText": " o "}, {"Name": "alone"}, 5]}}', ["n: v", "o", "alone"]),
    ('{"SingleInvoiceInfos": [{"b": "1", "a": {"Name": "x", "Value": "y"}, "c": ["p", {"z": "q"}, ["r"], 4]}]}', ["b: 1\nx: y\nc: p\nz: q"]),
    ('{"MixedInvoiceItems": [{}], "Text": "t\\r\\nu"}', ["t", "u"]), ('{"Text": {"Value": "deep"}, "OcrText": "o"}', ["deep"]),
    ('{"Response": {"a": [{"b": {"name": "1"}}, {"Value": " 2 "}], "text": "3"}, "name": "outside"}', ["1", "2", "3"]),
    ('{"Response": "x", "Name": "n"}', ["n"]),
])
def test_shapes(spark, answer, told):
    assert lines(spark, [answer]) == [told]


def texts_below(node):
    """All texts of keys that name texts, in order: what is left of an answer without lists of entries and whole texts."""
    stack, out = [(None, node)], []
    while stack:
        key, x = stack.pop()
        if isinstance(x, dict):
            stack += [*x.items()][::-1]
        elif isinstance(x, list):
            stack += [(None, y) for y in x][::-1]
        elif isinstance(x, str) and key and key.lower() in ("text", "name", "value") and x.strip():
            out.append(x.strip())
    return out


def test_texts_anywhere(spark):
    def value(depth):
        if not depth or RND.random() < 0.4:
            return RND.choice(["a", " b ", "", 0, True, None, 2.5])
        if RND.random() < 0.6:
            return {RND.choice(["NAME", "value", "x", "y", "Value"]): value(depth - 1) for _ in range(RND.randint(0, 4))}
        return [value(depth - 1) for _ in range(RND.randint(0, 3))]

    bodies = [{RND.choice("pqr"): value(5) for _ in range(3)} for _ in range(200)]
    assert lines(spark, [json.dumps(b) for b in bodies]) == [texts_below(b) or None for b in bodies]


def test_no_python_in_the_plan(spark):
    df = with_answer_text(spark.createDataFrame([('{"text": "x"}',)], "a string"), "a", "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first()["t"] == "x"
