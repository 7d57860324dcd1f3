"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is the unlabelled set, and nothing is taken for clean. A linear
classifier over the presence of words minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss: the second part estimates the risk on clean texts from unlabelled ones, corrected by the class prior,
and when a step makes it negative, which is overfitting, the step goes back up instead. Words enter if their frequency among
positives and unlabelled texts differs by ``LEAST_Z`` standard errors; Spark counts them. Training is numpy, in one task over a
bounded sample, of which it gets those words only; its rows are chosen by a hash of the id, so reruns agree. Scoring reads whole
texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.llm.kernels import IS_LETTER, segments, word_hashes
from quillspark.llm.storage import discarded, fresh, written

POSITIVES, UNLABELLED = 3000, 12000  # most rows of the training sample
MOST_WORDS = 20_000  # of the model
LEAST_Z, LEAST_DOCS = 4.5, 3
STEPS, RATE, DECAY = 400, 0.1, 1e-4


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def document_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per row the distinct hashes of its words: runs of letters."""
    h, bounds = word_hashes(data, offsets, IS_LETTER)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(h[a:b])


def risk(p, u, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk on positives, risk on clean texts as estimated, and the slopes of both by (w, b).

    p, u: (n, rows, words) of the positive and the unlabelled texts, one entry for each word that a text holds.
    """
    def parts(sets, sign):
        n, rows, words = sets
        z = sign * (np.bincount(rows, weights=w[words], minlength=n) + b)
        by_row = -sign / (1 + np.exp(z)) / n
        return np.logaddexp(0, -z).mean(), np.append(np.bincount(words, weights=by_row[rows], minlength=len(w)), by_row.sum())

    with np.errstate(over="ignore"):
        (hit, d_hit), (p_clean, d_p), (u_clean, d_u) = parts(p, 1), parts(p, -1), parts(u, -1)
    return prior * hit, u_clean - prior * p_clean, prior * d_hit, d_u - prior * d_p


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted word hashes, their weights, bias) from word sets. Without positives, unlabelled texts or a prior: a bias of -inf."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0), -np.inf
    if not positive or not unlabelled or prior <= 0:
        return none
    n_p, n_u = len(positive), len(unlabelled)
    words, count_p = np.unique(np.concatenate(positive), return_counts=True)
    words, count_p = words[count_p >= LEAST_DOCS], count_p[count_p >= LEAST_DOCS]
    flat_u = np.concatenate(unlabelled)
    count_u = np.bincount(np.searchsorted(words, flat_u[np.isin(flat_u, words)]), minlength=len(words))
    share = (count_p + count_u + 1) / (n_p + n_u + 2)
    z = (count_p / n_p - count_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:most_words])
    words = words[chosen[np.abs(z[chosen]) >= LEAST_Z]]

    def table(sets: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        known = np.isin(flat, words)
        return len(sets), rows[known], np.searchsorted(words, flat[known])

    p, u = table(positive), table(unlabelled)
    w, b = np.zeros(len(words)), -1.0
    moments = [np.zeros(len(words) + 1), np.zeros(len(words) + 1)]

    for step in range(1, STEPS + 1):
        _, clean, toward_hits, toward = risk(p, u, w, b, prior)
        g = toward_hits + toward if clean >= 0 else -toward
        g[:-1] += DECAY * w
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = RATE * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return words, w, float(b)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, packed words) of (positive, text), a megabyte of texts at a time."""
    for batch in batches:
        for row, data, offsets in segments(batch.column(1)):
            sets = [s.tobytes() for s in document_words(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sets, pa.binary())], names=["positive", "words"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, p, u): positive and unlabelled texts of a megabyte of ``_word_sets`` that hold the word."""
    for batch in batches:
        positive = batch.column(0).to_numpy(zero_copy_only=False)
        for row, data, offsets in segments(batch.column(1)):
            sizes = np.diff(offsets) // 8
            words, place = np.unique(data.view(np.uint64), return_inverse=True)
            p = np.bincount(place, weights=np.repeat(positive[row : row + len(sizes)], sizes), minlength=len(words)).astype(np.int64)
            u = np.bincount(place, minlength=len(words)) - p
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(p), pa.array(u)], names=["word", "p", "u"])


def _telling_words(packed: DataFrame, n_p: int, n_u: int, most_words: int) -> np.ndarray:
    """The sorted hashes of the words that ``train`` chooses, counted by Spark; ties to the smaller unsigned hash."""
    p, u = F.col("p"), F.col("u")
    share = (p + u + 1) / F.lit(n_p + n_u + 2)
    z = F.abs((p / F.lit(n_p) - u / F.lit(n_u)) / F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u)))
    counted = packed.mapInArrow(_tallied, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    telling = counted.where(p >= LEAST_DOCS).select("word", z.alias("z")).where(F.col("z") >= LEAST_Z)
    rows = telling.orderBy(F.desc("z"), F.col("word") < 0, "word").limit(most_words).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64))


def _restricted(packed: DataFrame, known: np.ndarray) -> DataFrame:
    """``packed`` (positive, words) with the words of ``known`` only; a text that holds none stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in segments(batch.column(1)):
                words, ends = data.view(np.uint64), offsets // 8
                place = np.searchsorted(known, words)
                held = place < len(known)
                held[held] = known[place[held]] == words[held]
                sets = [words[a:b][held[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sets, pa.binary())], names=["positive", "words"])

    return packed.mapInArrow(run, packed.schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", held_out: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from the documents and labels outside fold ``held_out``. A document labelled twice is toxic if any label says so.

    The prior is the toxic share of all labelled documents. The model is fitted, in one task, on a sample: at most
    ``positives`` confirmed toxic documents and ``unlabelled`` others, chosen by a hash of the id, and at most ``most_words``
    words. What it judges is every document. Without labels, positives or a prior nothing is toxic. Null ids take no part.
    """
    known = labels.where((fold(F.col("doc_id")) != held_out) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    facts = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()
    prior = facts[0] or 0.0
    some = known.where("toxic > 0").select("doc_id", F.lit(True).alias("positive")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    every = docs.where((fold(F.col("doc_id")) != held_out) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(False).alias("positive"))
    every = every.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    chosen = some.unionByName(every).distinct()  # at most positives + unlabelled rows
    sample = docs.select("doc_id", F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), "doc_id")

    none = np.zeros(0, dtype=np.uint64), np.zeros(0), -np.inf
    if prior <= 0:
        return none
    packed = written(sample.select("positive", "__text").mapInArrow(_word_sets, "positive boolean, words binary").distinct(), "toxicity-sample")  # copies count once
    try:
        sizes = {r["positive"]: r["count"] for r in packed.groupBy("positive").count().collect()}
        if len(sizes) < 2:
            return none
        known = _telling_words(packed, sizes[True], sizes[False], most_words)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets: dict[bool, list[bytes]] = {True: [], False: []}
            for batch in batches:
                for yes, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sets[yes].append(words)
            hashes, weights, bias = train(*[[np.frombuffer(x, dtype=np.uint64) for x in sorted(sets[yes])] for yes in (True, False)], prior, most_words)
            yield pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()]), pa.array([weights.tobytes()]), pa.array([bias])], names=["h", "w", "b"])

        model = _restricted(packed, known).repartition(1).mapInArrow(learn, "h binary, w binary, b double").first()
    finally:
        discarded(packed)
    return np.frombuffer(bytes(model["h"]), dtype=np.uint64), np.frombuffer(bytes(model["w"])), model["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); columns of those names are replaced.

    ``prefix`` goes before the new names.

    Null and empty texts get the score of the bias alone; the text, whole however long, is all that a score reads. Repeated
    rows score alike; an empty table gives an empty one. All other columns stay, whatever their names.
    """
    words, weights, bias = model
    kept = [c for c in docs.columns if c.lower() not in {(prefix + "score").lower(), (prefix + "predicted").lower()}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh("text", docs)))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(prefix + "score", T.DoubleType())])
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[words & np.uint64(0xFFFF)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in segments(batch.column(len(kept))):
                h, bounds = word_hashes(data, offsets, IS_LETTER)
                near = np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
                found = np.searchsorted(words, h[near]) if len(words) else np.zeros(0, dtype=np.int64)
                exact = found < len(words)
                exact[exact] = words[found[exact]] == h[near][exact]
                n = len(offsets) - 1
                pairs = np.unique((np.searchsorted(bounds, near[exact], side="right") - 1) * max(1, len(words)) + found[exact])
                sums = np.bincount(pairs // max(1, len(words)), weights=weights[pairs % max(1, len(words))], minlength=n)
                with np.errstate(over="ignore"):
                    scores = 1 / (1 + np.exp(-(sums + bias)))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns[:-1], pa.array(scores)], names=[*kept, prefix + "score"])

    return source.mapInArrow(run, schema).withColumn(prefix + "predicted", (F.col(prefix + "score") >= 0.5).cast("int"))
