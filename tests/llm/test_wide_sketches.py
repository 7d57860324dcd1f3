"""Large texts that share a passage only are told apart by their wide sketches, before whole sets are cut and sent."""

import numpy as np

from quillspark.llm import jaccard


def test_large_unlike_texts_send_no_sets(spark, monkeypatch):
    cut, sets = [], jaccard._sets

    def counted(texts, n):
        cut.append(texts.count())
        return sets(texts, n)

    monkeypatch.setattr(jaccard, "_sets", counted)
    passage = [f"common{i}" for i in range(1000)]
    docs = [(d, " ".join([f"w{d}x{i}" for i in range(1500)] + passage)) for d in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d for d in range(12)} and sum(cut) == 0
    changed = docs[3][1].split(" ")
    changed[::200] = [f"new{i}" for i in range(len(changed[::200]))]
    docs.append((99, " ".join(changed)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d for d in range(12)} | {99: 3} and 2 <= sum(cut) <= 4


def test_narrowing_loses_no_linked_pair(spark):
    rng, t = np.random.default_rng(5), jaccard.Threshold(8, 10)
    rows, pairs, linked = [], [], set()
    for i in range(120):
        size, moved = int(rng.integers(200, 3000)), float(rng.uniform(0, 0.2))
        x = rng.integers(0, 1 << 63, size=size).astype(np.uint64)
        y = np.concatenate([x[: int(size * (1 - moved))], rng.integers(0, 1 << 63, size=int(size * moved)).astype(np.uint64)])
        for name, s in ((f"a{i}", np.unique(x)), (f"b{i}", np.unique(y))):
            w = jaccard.wide_sketch(s)
            assert np.array_equal(jaccard.folded(s), jaccard.folded_to(w, jaccard.FOLD_WORDS)) and len(w) * 32 >= len(s)
            if len(w) > jaccard.FOLD_WORDS:
                rows.append((name, len(s), w.tobytes()))
        pairs.append((f"a{i}", f"b{i}", i))
        linked |= {i} if t.linked(np.unique(x), np.unique(y)) else set()
    wides = spark.createDataFrame(rows, "class string, size long, wide binary")
    kept = {r["i"] for r in jaccard._narrowed(spark.createDataFrame(pairs, "a string, b string, i long"), wides, t).collect()}
    assert linked and linked <= kept and len(kept) < 120
