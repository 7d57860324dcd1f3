"""Texts from the JSON answers of OCR services, by SQL alone.

An answer becomes a flat list of its nodes in document order, each with its place, key, kind and raw text: level by level, every
object or array of the level puts its children behind itself. Reading as a map of strings keeps the order and the raw
text of children, reading as a map of variants tells their kinds. Then rules pick lines from the list: plain answers have ``text``
or else ``lines``; those of invoice services hold lists of entries, whole texts, or texts anywhere, and the first of these that gives
any counts. What an entry says is folded from its deepest level up. Nothing leaves the JVM.

``answer_lines`` is the expression for a column; ``ocr_answer_lines(answer)`` is a table function for SQL. Answers nested deeper
than ``MOST_LEVELS`` are read to that level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions.text import WHITE

MOST_LEVELS = 64
# Where the answers of invoice OCR services hold entries and texts.
ENTRY_LISTS, WHOLE_TEXTS, NAME, VALUE, TEXT_KEYS = ["MixedInvoiceItems", "SingleInvoiceInfos"], ["Text", "OcrText"], "Name", "Value", ["text", "name", "value"]

_NODE = "place: ARRAY<INT>, key: STRING, kind: STRING, raw: STRING, said: STRING"
_NODES = f"ARRAY<STRUCT<{_NODE}>>"
_BLANKS = "'" + "".join(f"\\u{ord(c):04X}" for c in WHITE) + "'"


def _filled(x: str) -> str:
    return f"nullif(btrim({x}, {_BLANKS}), '')"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _named(nodes: str, key: str) -> str:
    """The first of ``nodes`` with a key."""
    return f"get(filter({nodes}, y -> y.key = '{key}'), 0)"


_KIND = "CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant({v}) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant({v}) = 'STRING' THEN 'string' ELSE 'other' END"


def _node(place: str, key: str, kind: str, raw: str, said: str = "cast(NULL AS STRING)") -> str:
    return f"named_struct('place', {place}, 'key', {key}, 'kind', {kind}, 'raw', {raw}, 'said', {said})"


def _nodes(answer: str) -> str:
    """All nodes of an answer that is an object."""
    root = _node("cast(array() AS ARRAY<INT>)", "cast(NULL AS STRING)", "'object'", answer)
    place = "concat(n.place, array(cast(i AS INT)))"
    raw, value = "z.`0`", "z.`1`"  # of arrays_zip
    fields, values = _node(place, f"{raw}.key", _KIND.format(v=value), f"{raw}.value"), _node(place, "cast(NULL AS STRING)", _KIND.format(v=value), raw)
    children = {
        "object": f"transform(arrays_zip(map_entries(from_json(n.raw, 'map<string,string>')), map_values(from_json(n.raw, 'map<string,variant>'))), (z, i) -> {fields})",
        "array": f"transform(arrays_zip(from_json(n.raw, 'array<string>'), from_json(n.raw, 'array<variant>')), (z, i) -> {values})"}
    grown = "CASE " + " ".join(f"WHEN size(n.place) = d - 1 AND n.kind = '{k}' THEN concat(cast(array(n) AS {_NODES}), cast({x} AS {_NODES}))" for k, x in children.items()) + f" ELSE cast(array(n) AS {_NODES}) END"
    levels = f"least({MOST_LEVELS}, length({answer}) - length(translate({answer}, '{{[', '')))"
    return f"aggregate(sequence(1, greatest(1, {levels})), cast(array({root}) AS {_NODES}), (all, d) -> cast(flatten(transform(all, n -> {grown})) AS {_NODES}))"


def _first(nodes: str, keys: list[str]) -> str:
    """The first of ``nodes`` with something in it, by the order of ``keys``."""
    counts = "(x.kind = 'string' AND x.raw <> '' OR x.kind IN ('object', 'array') AND x.raw NOT IN ('{}', '[]') OR x.kind = 'other' AND x.raw NOT IN ('0', '0.0', 'false'))"
    return "coalesce(" + ", ".join(f"get(filter({nodes}, x -> x.key = '{k}' AND {counts}), 0)" for k in keys) + ")"


def _entry() -> str:
    """What the object or array ``n`` says, from its children ``c``: ``name: value``, else one text, else all its texts under their keys."""
    one = _first("c", [*WHOLE_TEXTS, VALUE, NAME])
    pair = f"concat({_filled(_named('c', NAME) + '.raw')}, ': ', {_filled(_named('c', VALUE) + '.raw')})"
    both = f"{_named('c', NAME)}.kind = 'string' AND {_named('c', VALUE)}.kind = 'string'"
    each = f"CASE WHEN x.kind = 'string' THEN concat(coalesce(x.key, n.key), ': ', {_filled('x.raw')}) WHEN x.kind = 'object' OR n.kind = 'object' THEN x.said END"
    every = f"nullif(array_join(filter(transform(c, x -> {each}), s -> s IS NOT NULL), '\\n'), '')"
    direct = _let("one", one, f"CASE WHEN one.kind = 'string' THEN {_filled('one.raw')} END")
    return f"CASE WHEN n.kind = 'object' THEN coalesce(CASE WHEN {both} THEN {pair} END, {direct}, {every}) ELSE {every} END"


def _told(nodes: str) -> str:
    """``nodes`` with what each object and array says, from the deepest level up."""
    below = "filter(all, c -> size(c.place) = d + 1 AND slice(c.place, 1, d) = n.place)"
    said = _let("c", below, _entry())
    one = f"CASE WHEN size(n.place) = d AND n.kind IN ('object', 'array') THEN {_node('n.place', 'n.key', 'n.kind', 'n.raw', said)} ELSE n END"
    levels = "sequence(array_max(transform(nodes, n -> size(n.place))), 0, -1)"
    return f"aggregate({levels}, {nodes}, (all, d) -> cast(transform(all, n -> {one}) AS {_NODES}))"


def _lines(text: str) -> str:
    return f"filter(transform(split({text}, '\\\\r\\\\n|[\\\\n\\\\r\\\\x0b\\\\x0c\\\\x1c-\\\\x1e\\\\x85\\\\u2028\\\\u2029]', -1), t -> {_filled('t')}), t -> t IS NOT NULL)"


def lines_sql(answer: str) -> str:
    """The SQL expression for the lines of ``answer``, the name of a string column: an array, null for what is no answer."""
    top, under = "filter(nodes, n -> size(n.place) = 1)", "filter(nodes, n -> size(n.place) > size(base) AND slice(n.place, 1, size(base)) = base)"
    inner = "filter(nodes, n -> size(n.place) = size(base) + 1 AND slice(n.place, 1, size(base)) = base)"
    text, listed = _named(top, "text"), _named(top, "lines")
    of_lines = (f"filter(transform(filter(nodes, n -> size(n.place) = 3 AND n.key = 'text' AND n.place[0] = {listed}.place[0] AND n.kind <> 'other'), n -> {_filled('n.raw')}), t -> t IS NOT NULL)")
    entries = [
        f"""filter(transform(filter(nodes, n -> n.kind = 'object' AND size(n.place) = size(base) + 2
          AND slice(n.place, 1, size(base) + 1) = {_named(inner, key)}.place AND {_named(inner, key)}.kind = 'array'), n -> n.said), t -> t IS NOT NULL)""" for key in ENTRY_LISTS]
    whole = _let("one", _first(inner, WHOLE_TEXTS), "CASE WHEN one.kind = 'string' THEN one.raw END")
    anywhere = f"""filter(transform(filter({under}, n -> n.kind = 'string' AND lower(n.key) IN ({", ".join(f"'{k}'" for k in TEXT_KEYS)})), n -> {_filled('n.raw')}), t -> t IS NOT NULL)"""
    some = "CASE WHEN size({x}) > 0 THEN {x} END"
    picked = "coalesce(" + ", ".join(_let("found", x, some.format(x="found")) for x in [*entries, f"coalesce({_lines(whole)}, cast(array() AS ARRAY<STRING>))", anywhere]) + ")"
    response = _named(top, "Response")
    base = f"CASE WHEN {response}.kind = 'object' THEN {response}.place ELSE cast(array() AS ARRAY<INT>) END"
    service = _let("nodes", _told("nodes"), _let("base", base, picked))
    ruled = f"CASE WHEN {text}.kind = 'string' THEN {_lines(text + '.raw')} WHEN {listed}.kind = 'array' THEN {of_lines} ELSE {service} END"
    return f"CASE WHEN schema_of_variant(try_parse_json({answer})) LIKE 'OBJECT%' THEN {_let('nodes', _nodes(answer), ruled)} END"


def answer_lines(answer: str) -> Column:
    """The lines of the answer in the column ``answer``; null if it is no JSON object, or one without any text where texts are looked for."""
    return F.expr(lines_sql(f"`{answer}`"))


def with_answer_text(df: DataFrame, answer: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: the lines of the answer in the column ``answer``, joined."""
    return df.withColumn(name, F.array_join(answer_lines(answer), "\n"))


def register_answers(spark: SparkSession) -> None:
    """Makes the table function ``ocr_answer_lines(answer)`` (position, line) known to the session's SQL."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ocr_answer_lines(answer STRING) RETURNS TABLE (position INT, line STRING) RETURN SELECT pos, col FROM (SELECT posexplode({lines_sql('answer')}))")
