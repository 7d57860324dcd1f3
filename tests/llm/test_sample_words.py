"""The sample of the toxicity classifier: its words are counted by Spark, and its one task gets no others."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import toxicity
from quillspark.llm.storage import BATCH_BYTES, written


def _sets(n, telling):
    rng = np.random.default_rng(n)
    rare = rng.integers(1 << 40, 1 << 63, (n, 300), dtype=np.uint64) * np.uint64(2)
    some = [np.array(telling, dtype=np.uint64)[rng.random(len(telling)) < 0.7] for _ in range(n)]
    return [np.unique(np.concatenate([r, s])) for r, s in zip(rare, some, strict=True)]


def test_training_task_gets_only_telling_words(spark):
    common = list(range(1, 6))
    positive, unlabelled = _sets(60, [*common, 2**64 - 7, 11, 12]), _sets(300, common)
    rows = [(True, bytearray(s.tobytes())) for s in positive] + [(False, bytearray(s.tobytes())) for s in unlabelled]
    packed = spark.createDataFrame(rows, "positive boolean, words binary").repartition(3)
    words, weights, bias = toxicity.train(positive, unlabelled, 0.2)
    known = toxicity._telling_words(packed, 60, 300, 20_000)
    assert known.tolist() == words.tolist() and {11, 12, 2**64 - 7} <= set(known.tolist())
    assert len(toxicity._telling_words(packed, 60, 300, 2)) == 2
    few = toxicity._restricted(packed, known).collect()
    assert len(few) == 360 and max(len(r["words"]) for r in few) <= 8 * len(known)
    sets = [[np.frombuffer(bytes(r["words"]), dtype=np.uint64) for r in few if r["positive"] == yes] for yes in (True, False)]
    again = toxicity.train(*sets, 0.2)
    assert again[0].tolist() == words.tolist() and np.allclose(again[1], weights, atol=1e-9) and abs(again[2] - bias) < 1e-9


def test_batches_for_python_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    long = spark.range(6000).repartition(1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    got = [r["n"] for r in written(long.mapInArrow(sizes, "n long"), "batches").collect()]
    assert sum(got) >= 30_000_000 and max(got) <= 1.1 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
