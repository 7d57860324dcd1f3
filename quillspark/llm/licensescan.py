"""Licence scans: phrases and tags by one Aho-Corasick pass over words, licence expressions by a shunting yard.

A text's words (A-Z in lower case) are joined by single blanks, so that a phrase of whole words is one pattern and all
patterns are found in one pass, overlapping ones too. Phrases name a licence. Tags announce an expression: what follows in the
raw text, up to the end of its line, is read as licence identifiers joined by ``and``, ``or``, ``with`` and parentheses
and put into postfix order by operator precedence; the longest beginning that is a whole expression counts. Its value is the
permission that the reader is left with: the best of alternatives, the worst of what holds together, one step more under an
exception. After tags that prose uses as well, the first identifier must be a known one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.llm.storage import fresh

# Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Phrases of licence notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gplv2": "gpl", "gplv3": "gpl", "apache software license": "apache", "mozilla public license": "mpl", "eclipse public license": "epl",
    "european union public licence": "eupl", "common development and distribution license": "cddl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "boost software license": "bsl", "zlib license": "zlib", "free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0 1 0 universal": "cc0",
}
# Tags, and whether only a known identifier may follow.
TAGS = {"spdx license identifier": False, "license": True, "licence": True, "licensed under": True, "released under": True, "distributed under": True}
# What families of identifiers permit. 3: with few duties, 2: changes stay open, 1: works around stay open, 0: not free.
PERMISSION = {
    "mit": 3, "apache": 3, "bsd": 3, "isc": 3, "bsl": 3, "zlib": 3, "unlicense": 3, "cc0": 3, "0bsd": 3, "cc-by": 3,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2, "eupl": 2, "gpl": 1, "agpl": 1, "cc-by-sa": 1, "cc-by-nc": 0, "cc-by-nd": 0, "cc-by-nc-sa": 0, "cc-by-nc-nd": 0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
WEIGHT = {"base": 0.5, "notice": 0.8, "tag": 0.9, "unknown": 0.6}  # of a kind of finding, for the score

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_LEAD = re.compile(rb"[ \t:=\"'`]*(?:(?:the|a)[ \t]+)?", re.I)
_BREAK = re.compile(rb"[\r\n]|\Z")
_FAMILY = re.compile(r"(.*?)(-v?\d[\d.]*)?(-[23]-clause)?(-only|-or-later|\+)?")


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, with blanks around: (number of words, kind, label or whether a known identifier must follow)."""
    found: dict[str, list] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase, value in table.items():
            found.setdefault(phrase, []).append((len(phrase.split()), kind, value))
    a = ahocorasick.Automaton()
    for phrase, what in found.items():
        a.add_word(f" {phrase} ", what)
    a.make_automaton()
    return a


def family(identifier: str) -> str:
    """An identifier without its version: GPL-2.0-or-later is gpl."""
    name = _FAMILY.fullmatch(identifier.lower())[1]
    return name.removesuffix("-clause").removesuffix("-2").removesuffix("-3") if name.startswith("bsd") else name


def postfix(tokens: Iterable[str]) -> tuple[list[str], int]:
    """(the longest beginning of ``tokens`` that is a whole expression in postfix order, the tokens of it); reads no further than the grammar allows."""
    out, held, operand, best = [], [], True, (0, (), 0)
    for n, token in enumerate(tokens, 1):
        word = token.lower()
        if operand:
            if token == "(":
                held.append("(")
                continue
            if token == ")" or word in PRECEDENCE:
                break
            out.append(token)
            operand = False
        elif token == ")":
            if "(" not in held:
                break
            while (op := held.pop()) != "(":
                out.append(op)
        elif word in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            break
        if not operand and "(" not in held:
            best = len(out), tuple(held[::-1]), n
    size, rest, n = best
    return out[:size] + list(rest), n


def families(order: list[str]) -> set[str]:
    """The families that a postfix expression names, exceptions apart."""
    return {family(t) for t, after in zip(order, [*order[1:], ""], strict=True) if t not in PRECEDENCE and after != "with"}


def permission(order: list[str]) -> int:
    """What a postfix expression permits; unknown identifiers permit nothing."""
    stack: list[int] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(PERMISSION.get(family(token), 0))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(min(3, left + 1) if token == "with" else (max if token == "or" else min)(left, right))
    return stack[0]


def expression(raw: bytes, at: int, stop: int, known: bool) -> tuple[int, int, list[str]] | None:
    """(start, end, postfix order) in bytes of the expression that ``raw`` holds at ``at``, behind signs and an article."""
    start = at = _LEAD.match(raw, at, stop).end()
    ends = []

    def tokens() -> Iterator[str]:
        nonlocal at
        while m := _TOKEN.match(raw, at, stop):
            at, token = m.end(), m[1].decode()
            bare = token.rstrip(".:") or token
            if known and not ends and token != "(" and family(bare) not in PERMISSION:
                return
            ends.append(at - len(token) + len(bare))
            yield bare
            if bare != token:  # the end of a sentence
                return

    order, n = postfix(tokens())
    return (start, ends[n - 1], order) if n else None


def scan(text: str) -> dict:
    """n_words, places (word, label, whether of the base scan) and expressions (start and end in code points, postfix order, labels, permission)."""
    raw = text.encode()
    lower = raw.lower()
    words = _WORD.findall(lower)
    line = f" {b' '.join(words).decode('latin-1')} " if words else ""
    places, tags, seen, counted = [], {}, 0, 0
    for end, what in automaton().iter(line):
        counted += line.count(" ", seen, end)  # blanks before the last one of the match
        seen = end
        for n, kind, value in what:
            if kind == "tag":
                tags[counted - 1] = value and tags.get(counted - 1, True)
            else:
                places.append({"word": counted - n, "label": value, "base": kind == "base"})
    expressions, told, points, stop = [], 0, 0, -1
    spans = enumerate(_WORD.finditer(lower)) if tags else ()
    for word, m in spans:
        if word not in tags or m.end() < told:
            continue
        if stop < m.end():
            stop = _BREAK.search(raw, m.end()).start()
        found = expression(raw, m.end(), stop, tags[word])
        if found:
            start, end, order = found
            first = points + len(raw[told:start].decode())
            points, told = first + len(raw[start:end].decode()), end
            expressions.append({"start": first, "end": points, "expression": " ".join(order), "labels": sorted(families(order)), "permission": permission(order)})
    return {"n_words": len(words), "places": places, "expressions": expressions}


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``, a struct of n_words, places and expressions, instead of the text.

    places: (word, label, base), expressions: (start, end, expression, labels, permission); see ``scan``. Null texts count
    as empty; texts without licences get empty arrays. Repeated rows each keep theirs. Whole texts are read, one at a time,
    however long. All other columns stay, whatever their names; one named ``licenses`` is replaced. An empty table gives an
    empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in {"licenses", text.lower()}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh("text", docs)))
    kind = T.DataType.fromDDL(
        "struct<n_words:bigint,places:array<struct<word:bigint,label:string,base:boolean>>,"
        "expressions:array<struct<start:bigint,end:bigint,expression:string,labels:array<string>,permission:int>>>")
    place = pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
    said = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("permission", pa.int32())])
    found = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("expressions", pa.list_(said))])
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("licenses", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(value.as_py() or "") for value in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, found)], names=[*kept, "licenses"])

    return source.mapInArrow(run, schema)


def license_digest(found: DataFrame) -> DataFrame:
    """The columns of a licence report from the ``licenses`` of ``find_licenses``, by DataFrame functions.

    score: 1 - the product of 1 - ``WEIGHT`` over the distinct findings (kind and label), 0 without any. permission: the worst of
    the expressions, null without one. Rows without findings have null places, empty labels and score 0; an empty table
    stays empty.
    """
    places, expressions = F.col("licenses.places"), F.col("licenses.expressions")
    base = F.filter(places, lambda p: p["base"])
    words = F.transform(base, lambda p: p["word"])
    told = F.transform(places, lambda p: F.concat(F.when(p["base"], "base").otherwise("notice"), F.lit(":"), p["label"]))
    known = [x for x in sorted(PERMISSION)]

    def kinds(e: Column) -> Column:
        return F.transform(e["labels"], lambda x: F.concat(F.when(x.isin(known), "tag").otherwise("unknown"), F.lit(":"), x))

    findings = F.array_distinct(F.concat(told, F.flatten(F.transform(expressions, kinds))))
    doubt = F.aggregate(findings, F.lit(1.0), lambda left, f: left * (1 - F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv]), F.substring_index(f, ":", 1))))

    def labels(listed: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(listed)), ",")

    all_labels = F.concat(F.transform(places, lambda p: p["label"]), F.flatten(F.transform(expressions, lambda e: e["labels"])))
    return found.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels(F.transform(base, lambda p: p["label"])).alias("base_labels"), labels(all_labels).alias("labels"), (1 - doubt).alias("score"),
        F.array_join(F.transform(expressions, lambda e: e["expression"]), ",").alias("expressions"), F.array_min(F.transform(expressions, lambda e: e["permission"])).alias("permission"))
