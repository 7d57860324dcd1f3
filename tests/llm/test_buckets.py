"""Buckets that still hold several components: those of the same members once, distances by all 64 bits of a word."""

import numpy as np

from quillspark.llm import jaccard
from quillspark.llm.storage import written


def test_buckets_of_the_same_members_are_compared_once(spark):
    def keys(*k):
        return np.array(k, dtype=np.int64).tobytes()

    rows = [("a", "b", 2, keys(1, 2)), ("a", "c", 2, keys(1, 2)), ("a", "d", 1, keys(3)), ("a", "b", 1, keys(3)), ("e", "f", 1, keys(4))]
    met = spark.createDataFrame(rows, "a string, b string, shared long, keys binary")
    roots = written(spark.createDataFrame([("a", "a"), ("b", "a")], "node string, root string"), "test-roots")
    members = sorted((r["key"], r["class"]) for r in jaccard._mixed(met, roots).collect())
    assert members == [(1, "a"), (1, "b"), (1, "c"), (3, "a"), (3, "b"), (3, "d")]  # bucket 2 is bucket 1 again, bucket 4 a pair


def test_near_pairs_of_buckets(spark):
    t = jaccard.Threshold(8, 10)
    zero, one, far = [0] * 8, [-(1 << 63)] + [0] * 7, [-1] + [0] * 7  # 1 and 64 bits away
    nodes = written(spark.createDataFrame([("a", "a", 100, zero), ("b", "b", 100, one), ("c", "c", 100, far), ("d", "a", 100, zero)],
                                          "class string, root string, size long, sketch array<long>"), "test-nodes")
    members = spark.createDataFrame([(k, c) for k in range(40) for c in "abcd"], "key long, class string")
    for every, wanted in ((True, {("a", "b"), ("b", "d")}), (False, {("a", "b")})):
        assert {(r["a"], r["b"]) for r in jaccard._across(members, nodes, t, every).collect()} == wanted
