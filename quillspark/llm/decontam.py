"""Benchmark decontamination: word pairs find candidate passages in one pass, Smith-Waterman alignment scores them.

Words are runs of letters and digits, A-Z lower-cased. A passage holds an item when the best local alignment by words (2 for a
match, -1 for a mismatch or a gap) reaches ``SHARE`` of the score of an exact copy. The search loses no such passage: with m
of an item's n words matched, at most 2 (m - share n) edits stand between them, so that at least t = ceil(share n) - 1 of the
m - 1 steps from one matched word to the next have one edit or none. Such a step is a pair of words, adjacent or with one word
between, of both sides. So of any n - 1 - t + k places of the item at least k have their pairs in the passage; k is about half
of t, and the places are those whose pairs fewest items share. Where k such pairs stand within the words that an alignment can
cover, the passage is aligned. Items under ``WHOLE`` words, of which a word or two would reach the share, match as whole
sequences. At four words the share is two words in a row; set ``share`` higher for benchmarks of such items.

The items are sent to the tasks. No pair is dropped, however common, and nothing is dealt out by pair: a passage in a third of
all documents is aligned where these stand, equal passages once a task. Items are sent in slices of about ``SEED_SLICE`` pairs;
a larger benchmark takes a pass for each slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.kernels import IS_ALNUM, mix, randoms, segments, windows, word_hashes
from quillspark.llm.storage import fresh, small_enough, written

WHOLE = 4
SHARE = 0.5
SEED_SLICE = 2_000_000
BROADCAST_ROWS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
_BATCH_CELLS = 1 << 16
_AT_ONCE = 1 << 22  # hits of pairs and items that are sorted at once
_KEPT = 50_000  # alignments that a task remembers


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(score, start, end) of the best local alignment of each passage with its item; start and end: words of the passage.

    A cell holds the score in its upper half and the passage position where the alignment began in its lower half.
    """
    wide, long = max(map(len, passages)), max(map(len, items))
    p = np.zeros((len(passages), wide), dtype=np.uint64)
    q = np.zeros((len(passages), long), dtype=np.uint64)
    in_p, in_q = np.zeros(p.shape, dtype=bool), np.zeros(q.shape, dtype=bool)
    for i, (a, b) in enumerate(zip(passages, items, strict=True)):
        p[i, : len(a)], q[i, : len(b)] = a, b
        in_p[i, : len(a)], in_q[i, : len(b)] = True, True
    one = np.int64(1 << 32)
    fresh = np.arange(wide + 1, dtype=np.int64)[None, :]  # score 0, beginning here
    slide = -GAP * one * fresh
    above = np.repeat(fresh, len(passages), axis=0)
    best, best_end = np.zeros(len(passages), dtype=np.int64), np.zeros(len(passages), dtype=np.int64)
    for j in range(long):
        same = (p == q[:, j : j + 1]) & in_p & in_q[:, j : j + 1]
        row = np.maximum(above + GAP * one, fresh)
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + np.where(same, MATCH * one, MISMATCH * one))
        row = np.maximum.accumulate(row + slide, axis=1) - slide
        at = np.argmax(row >> np.int64(32), axis=1)
        top = row[np.arange(len(row)), at]
        better = (top >> np.int64(32)) > (best >> np.int64(32))
        best, best_end = np.where(better, top, best), np.where(better, at, best_end)
        above = row
    return [(int(b >> 32), int(b & 0xFFFFFFFF), int(e)) for b, e in zip(best, best_end, strict=True)]


def spaced(h: np.ndarray) -> np.ndarray:
    """The hash of each pair of words with one between, as ``windows`` has it for adjacent ones."""
    first, second = randoms(77, 2)
    return mix(h[:-2] * first + h[2:] * second)


def _item_table(items: DataFrame) -> DataFrame:
    """(item_id, words, n_words): hashes of an item's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for _, data, offsets in segments(batch.column(1)):
                h, bounds = word_hashes(data, offsets, IS_ALNUM)
                words += [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = [len(w) // 8 for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(sizes, pa.int32())], names=["item_id", "words", "n_words"])

    return items.select("item_id", "text").mapInArrow(run, T.StructType([items.schema["item_id"], *T.StructType.fromDDL("words binary, n_words int")]))


@dataclass
class Book:
    """Items as the tasks look them up: ``seeds`` sorted, the items of seed i at ``owners[first[i]:first[i + 1]]``."""

    ids: list[int | None]
    words: list[np.ndarray]
    least: np.ndarray  # share of an exact copy's score that counts
    span: np.ndarray  # words that an alignment which reaches it covers at most
    need: np.ndarray  # seeds that stand in it at least
    runs: list[int]  # lengths of the runs that are seeds besides pairs
    seeds: np.ndarray
    first: np.ndarray
    owners: np.ndarray


def book_of(ids: list[int | None], words: list[bytes], share: float) -> Book:
    words = [np.frombuffer(w, dtype=np.uint64) for w in words]
    size = np.array([len(w) for w in words])
    whole = size < WHOLE
    steps = np.ceil(share * size - 1e-9).astype(np.int64) - 1
    need = np.where(whole, 1, np.maximum(1, steps // 2))
    span = np.where(whole, size, np.ceil((3 - 2 * share) * size + 1e-9).astype(np.int64))
    pairs = [(windows(w, 2), spaced(w)) for w in words]
    shared, count = np.unique(np.concatenate([np.unique(np.concatenate(x)) for x in pairs]), return_counts=True)
    per_item = []
    for w, (near, far), t, k in zip(words, pairs, steps.tolist(), need.tolist(), strict=True):
        if len(w) < WHOLE:
            per_item.append(windows(w, len(w)))
        elif t < 1:
            per_item.append(np.unique(windows(w, 1)))
        else:
            cost = count[np.searchsorted(shared, near)]
            cost[: len(far)] += count[np.searchsorted(shared, far)]
            places = np.argsort(cost, kind="stable")[: len(w) - 1 - t + k]
            per_item.append(np.unique(np.append(near[places], far[places[places < len(far)]])))
    flat, owners = np.concatenate(per_item), np.repeat(np.arange(len(words)), [len(x) for x in per_item])
    order = np.argsort(flat, kind="stable")
    seeds, first = np.unique(flat[order], return_index=True)
    single = (size == 1) | (~whole & (steps < 1))
    runs = [n for n, used in ((1, single), (3, whole & (size == 3))) if used.any()]
    return Book(ids, words, np.where(whole, 1.0, share), span, need, runs, seeds, np.append(first, len(flat)), owners[order])


def seed_filter(seeds: np.ndarray) -> np.ndarray:
    """A table that the low bits of a seed point to; false: not a seed."""
    table = np.zeros(1 << max(16, min(24, int(len(seeds)).bit_length() + 5)), dtype=bool)
    table[seeds & np.uint64(len(table) - 1)] = True
    return table


def candidates(h: np.ndarray, bounds: np.ndarray, book: Book, table: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, low, high): the words of the rows, cut by ``bounds``, that are to be aligned with an item."""
    ats, places = [], []
    for length, grams in [(2, windows(h, 2)), (3, spaced(h)), *((n, windows(h, n)) for n in book.runs)]:
        at = np.flatnonzero(table[grams & np.uint64(len(table) - 1)])
        place = np.minimum(np.searchsorted(book.seeds, grams[at]), len(book.seeds) - 1)
        real = (book.seeds[place] == grams[at]) & (at + length <= bounds[np.searchsorted(bounds, at, side="right")])
        ats.append(at[real])
        places.append(place[real])
    order = np.argsort(np.concatenate(ats), kind="stable")
    all_at, all_place = np.concatenate(ats)[order], np.concatenate(places)[order]
    all_doc = np.searchsorted(bounds, all_at, side="right") - 1
    part = np.cumsum(np.diff(book.first)[all_place]) // _AT_ONCE
    part = part[np.searchsorted(all_doc, all_doc)]  # a document's hits stay together
    for hits in np.split(np.arange(len(all_at)), np.flatnonzero(np.diff(part)) + 1):
        first, n = book.first[all_place[hits]], np.diff(book.first)[all_place[hits]]
        owner = book.owners[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        item, at = np.divmod(np.unique(owner * len(h) + np.repeat(all_at[hits], n)), max(1, len(h)))
        doc = np.searchsorted(bounds, at, side="right") - 1
        last = np.arange(len(at)) + book.need[item] - 1
        end = np.minimum(last, len(at) - 1)
        fits = np.flatnonzero((last == end) & (item[end] == item) & (doc[end] == doc) & (at[end] - at < book.span[item]))
        item, doc, low, high = item[fits], doc[fits], at[end[fits]] + 1, at[fits]
        low, high = np.maximum(low - book.span[item], bounds[doc]), np.minimum(high + book.span[item], bounds[doc + 1])
        if len(fits):
            new = np.append(True, (np.diff(item) != 0) | (np.diff(doc) != 0) | (low[1:] > high[:-1]))
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(fits)) - 1
            yield from zip(doc[begins].tolist(), item[begins].tolist(), low[begins].tolist(), high[ends].tolist(), strict=True)


def align_all(passages: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """``align`` in batches of like sizes."""
    order, at, results = np.lexsort(([len(x) for x in items], [len(x) for x in passages])).tolist(), 0, {}
    while at < len(order):
        n = max(1, min(256, _BATCH_CELLS // max(1, len(passages[order[min(len(order) - 1, at + 255)]]))))
        part = order[at : at + n]
        results |= dict(zip(part, align([passages[i] for i in part], [items[i] for i in part]), strict=True))
        at += n
    return [results[i] for i in range(len(order))]


def _found(docs: DataFrame, items: DataFrame) -> T.StructType:
    """The schema of what is found, with ids of the types that the tables have."""
    own = T.StructType.fromDDL("text_key long"), T.StructType.fromDDL("similarity double, start long, end long")
    return T.StructType([docs.schema["doc_id"], *own[0], items.schema["item_id"], *own[1]])


def _matches(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    rows, schema, id_type = items.select("item_id", "words").collect(), _found(docs, items), to_arrow_type(items.schema["item_id"].dataType)
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    book = book_of([r["item_id"] for r in rows], [bytes(r["words"]) for r in rows], share)
    sent = docs.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, known = sent.value, {}
        table = seed_filter(book.seeds)
        for batch in batches:
            for row, data, offsets in segments(batch.column(2)):
                h, bounds = word_hashes(data, offsets, IS_ALNUM)
                found, fresh = [], {}
                for doc, item, low, high in candidates(h, bounds, book, table):
                    key = (item, blake2b(h[low:high].tobytes(), digest_size=16).digest())
                    found.append((row + doc, item, low - int(bounds[doc]), key))
                    if key not in known:
                        fresh[key] = h[low:high]
                if not found:
                    continue
                known |= dict(zip(fresh, align_all(list(fresh.values()), [book.words[i] for i, _ in fresh]), strict=True)) if fresh else {}
                held = [(r, i, first, known[key]) for r, i, first, key in found if known[key][0] / (MATCH * len(book.words[i])) >= book.least[i]]
                if len(known) > _KEPT:
                    known = {}
                picked = batch.select([0, 1]).take(pa.array([r for r, *_ in held], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array([book.ids[i] for _, i, *_ in held], id_type),
                     pa.array([score / (MATCH * len(book.words[i])) for _, i, _, (score, *_) in held], pa.float64()),
                     pa.array([first + a for *_, first, (_, a, _) in held], pa.int64()), pa.array([first + b for *_, first, (_, _, b) in held], pa.int64())],
                    names=["doc_id", "text_key", "item_id", "similarity", "start", "end"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start, end): the best passage of each document that holds each item.

    docs: doc_id, text; items: item_id, text. start and end count words of the text. text_key (xxhash64 of the text) tells
    documents of one id apart; rows that agree in both give one row an item. Null and empty texts hold nothing; items under
    ``WHOLE`` words match as whole sequences, those without words not at all; repeated items match alike. An empty table on
    either side gives an empty result. Ids may be of any type. Whole texts are read, however long; other columns take no part.
    """
    table = written(_item_table(items).where("n_words > 0"), "decontam-items")
    total = table.agg(F.sum(2 * F.col("n_words"))).first()[0] or 0
    none = docs.sparkSession.createDataFrame([], _found(docs, items))
    if not total:
        return none
    slices = math.ceil(total / SEED_SLICE)
    found = none
    for i in range(slices):
        part = table if slices == 1 else table.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)) == i)
        found = found.unionByName(_matches(docs, part, share)) if slices > 1 else _matches(docs, part, share)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("early"), "start", "end"))
    return found.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_key", "item_id", "best.similarity", "best.start", "best.end")


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the documents that ``found`` names by doc_id and text_key; all rows and columns else stay."""
    named = small_enough(written(found.select("doc_id", "text_key").distinct(), "decontam-found"), BROADCAST_ROWS)
    key = fresh("text_key", docs)
    d, f = docs.withColumn(key, F.xxhash64("text")).alias("d"), named.alias("f")
    same = (F.col(f"d.{key}") == F.col("f.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    return d.join(f, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
