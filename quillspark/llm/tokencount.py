"""Token counts without token ids: pieces are counted once per distinct pre-token and summed over frequencies.

Three steps. The distinct pre-tokens of all documents with their frequencies, combined before the one shuffle. The library
counts the pieces of each, once. Counts then join to the pre-tokens of each document: those of the most frequent ones, at
most ``HOT``, by a table that is sent to the tasks; the rest, each in few documents, by a join of
(document, pre-token, frequency). The table names pre-tokens over ``NAME_CHARS`` by their SHA-256. So what is sent is bounded
whatever the corpus, and no frequent key is ever dealt, however long.

Pre-tokens are cut by the published pattern of byte-level BPE in the JVM. Texts with special strings of the tokenizer, or with
characters that the JVM's version of Unicode does not know and the library's may, are counted whole by the library. So are
all texts where a tokenizer is of another kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillspark.llm.storage import discarded, written

HOT, NAME_CHARS = 200_000, 32
LIBRARY_BATCH = 4096
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
# The characters that Unicode classes as white space, and the published pre-token pattern of byte-level BPE with them.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


@cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """texts -> numbers of tokens, by the library of the file: without added special tokens, truncation and padding."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for i in range(0, len(texts), LIBRARY_BATCH)
                          for e in t.encode_batch_fast(texts[i : i + LIBRARY_BATCH], add_special_tokens=False)]


def special_strings(path: str) -> list[str] | None:
    """The strings that the tokenizer cuts out before pre-tokens; None unless nothing but byte-level pre-tokens of the pattern acts."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or {k: pre.get(k) for k in _BYTE_LEVEL} != _BYTE_LEVEL:
        return None
    return [t["content"] for t in spec.get("added_tokens", [])]


def _counted(units: DataFrame, path: str) -> DataFrame:
    """``units`` (unit, freq) with pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=["unit", "freq", "pieces"])

    return units.mapInArrow(run, "unit string, freq long, pieces long")


def _name(unit: str) -> str:
    """A pre-token as the table of hot ones has it."""
    return unit if len(unit) <= NAME_CHARS else sha256(unit.encode()).hexdigest()


def _hottest(pieces: DataFrame, most: int) -> tuple[dict[str, int], DataFrame | None]:
    """Pieces of the most frequent pre-tokens, at most ``most``; and the table of all others, None if there are none.

    All of a power of two of frequencies are hot or none are.
    """
    level = F.length(F.bin("freq"))
    levels = dict(map(tuple, pieces.groupBy(level).count().collect()))
    least, held = None, 0
    for at in sorted(levels, reverse=True):
        if held + levels[at] > most:
            break
        least, held = at, held + levels[at]
    if least is None:
        return {}, pieces
    name = F.when(F.length("unit") <= NAME_CHARS, F.col("unit")).otherwise(F.sha2(F.col("unit").cast("binary"), 256))
    table = {unit: n for unit, n in pieces.where(level >= least).select(name, "pieces").collect()}
    return table, pieces.where(level < least) if held < sum(levels.values()) else None


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit instead of the text; columns of those names are replaced, all others stay.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside texts are tokens as the library's default has it.
    Repeated rows and ids each keep their row; an empty table gives an empty one.
    """
    named = {"n_bytes", "n_tokens", "over_limit", text.lower()}
    kept = [c for c in docs.columns if c.lower() not in named]
    own = [f"c{i}" for i in range(len(kept))]
    source = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    specials = special_strings(path)
    whole = F.lit(True)
    if specials is not None:
        whole = F.col("text").rlike("|".join([r"\p{Cn}", *map(re.escape, filter(None, specials))]))
    pre = F.when(~whole, F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0)))
    hot, cold = {}, None
    if specials is not None:
        units = written(source.select(F.explode(pre).alias("unit")).groupBy("unit").agg(F.count("*").alias("freq")), "token-units")
        pieces = written(_counted(units, path), "token-pieces")
        discarded(units)
        hot, cold = _hottest(pieces, HOT)
        if cold is None:
            discarded(pieces)
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            cuts, odd = batch.column(len(own)), batch.column(len(own) + 1)
            sizes = np.array(pa.compute.list_value_length(cuts).fill_null(0), dtype=np.int64)
            coded = cuts.flatten().dictionary_encode()
            known = np.array([sent.value.get(_name(u), -1) for u in coded.dictionary.to_pylist()] or [0], dtype=np.int64)
            code, row = np.asarray(coded.indices), np.repeat(np.arange(len(sizes)), sizes)
            n = np.zeros(len(sizes), dtype=np.int64)
            np.add.at(n, row, np.maximum(known, 0)[code])
            rare = np.flatnonzero(known[code] < 0) if len(code) else np.zeros(0, dtype=np.int64)
            pairs, times = np.unique(row[rare] * (len(known) + 1) + code[rare], return_counts=True)
            rows, units = pairs // (len(known) + 1), coded.dictionary.take(pa.array(pairs % (len(known) + 1)))
            ends = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32())
            left = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([units.cast(pa.string()), pa.array(times, pa.int64())], names=["unit", "n"]))
            at = np.flatnonzero(np.asarray(odd.is_valid()))
            for i, x in zip(at, count(odd.take(pa.array(at)).to_pylist()), strict=True):
                n[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], batch.column(len(own) + 2), pa.array(n), left], names=[*own, "bytes", "tokens", "rare"])

    fields = [T.StructField(o, docs.schema[c].dataType) for c, o in zip(kept, own, strict=True)]
    rare = T.ArrayType(T.StructType([T.StructField("unit", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("bytes", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("rare", rare)])
    counted = source.select(*own, pre.alias("pre"), F.when(whole, F.col("text")).alias("odd"), F.octet_length("text").cast("long").alias("bytes")).mapInArrow(run, schema)
    if cold is not None:
        counted = written(counted.withColumn("row", F.monotonically_increasing_id()), "token-rows")
        met = counted.select("row", F.explode("rare").alias("r")).select("row", "r.unit", "r.n").join(cold.select("unit", "pieces"), "unit")
        sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
        counted = counted.join(sums, "row", "left").withColumn("tokens", F.col("tokens") + F.coalesce("more", F.lit(0)))
    return counted.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], F.col("bytes").alias("n_bytes"), F.col("tokens").alias("n_tokens"),
                          (F.col("tokens") > limit).alias("over_limit"))
