"""Clustering, licence scans and hard negatives against plain versions on odd tables."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import hamerly, hardneg, licensescan, storage

RND = random.Random(9)
VECTORS = "vec_id long, embedding array<double>, label string, cluster int, block string, a_ids string"


def floor_of(x, scale):
    return math.floor(Fraction(x) * scale)


def table(dims=4, n=150):
    points = [[RND.choice([-1, 0, 0.5, 1]) + RND.random() * 0.2 for _ in range(dims)] for _ in range(n)]
    rows = [(i, p, str(i % 4), 1, "b", "c") for i, p in enumerate(points)]
    rows += rows[:5] + [(i + 1000, points[7], "3", 2, "b", None) for i in range(40)]  # repeated rows, a common vector
    rows += [(None, points[3], "1", 0, "", ""), (2000, None, "1", 0, "", ""), (2001, points[1][:-1], "1", 0, "", ""), (2002, [None] * dims, "1", 0, "", ""), (2003, [math.nan] * dims, "1", 0, "", ""),
             (2004, [math.inf] * dims, "1", 0, "", ""), (2005, [], "1", 0, "", ""), (2100, points[2], None, 0, "", "")]
    return rows


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [floor_of(x, scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        found = []
        for i, v in kept:
            found.append((i, *min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)), v))
        if turn < rounds:
            for n in range(len(centers)):
                mine = [v for _, _, c, v in found if c == n]
                if mine:
                    centers[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, c, min(d, 2**63 - 1)) for i, d, c, _ in found), key=str), centers


@pytest.mark.parametrize("k,scale", [(7, 256), (400, 1), (1, 3)])
def test_clusters(spark, k, scale):
    rows = table()
    found, centers = hamerly.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), k, 4, 4, scale, bucket_bytes=200)
    assert found.columns == ["vec_id", "cluster", "distance"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want, wanted = brute_clusters(rows, k, 4, 4, scale)
    assert got == want and centers == wanted
    told = hamerly.with_inertia(found, centers).collect()
    sums = {c: sum(d for _, x, d in want if x == c) for c in {x for _, x, _ in want}}
    assert len(told) == len(want) and all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in told)
    assert {r["centroid_sha256"] for r in told} == {hashlib.sha256(",".join(map(str, wanted[c])).encode()).hexdigest() for c in sums}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspark_")]


def test_clusters_of_huge_and_no_vectors(spark):
    rows = [(i, [RND.choice([-1, 1]) * 10.0 ** RND.choice([0, 5, 12, 20, 250]) * RND.random(), float(i)], "", 0, "", "") for i in range(60)]
    found, centers = hamerly.cluster_vectors(spark.createDataFrame(rows, VECTORS), 5, 3, 2, 256)
    assert (sorted((tuple(r) for r in found.collect()), key=str), centers) == brute_clusters(rows, 5, 3, 2, 256)
    none = spark.createDataFrame([], VECTORS)
    assert hamerly.with_inertia(*hamerly.cluster_vectors(none, 5, 3, 2, 256)).collect() == []


@given(st.integers(0, 10**6), st.sampled_from([1, 3, 1000, 10**9]))
@settings(max_examples=60, deadline=None)
def test_bounds_never_hide_a_nearer_centroid(seed, spread):
    gen = np.random.default_rng(seed)
    v = gen.integers(-spread, spread + 1, (60, 3)).astype(float)
    centers, state = hamerly.Centers([[int(x) for x in r] for r in v[:6]]), (None, None, None)
    for _ in range(4):
        *state, _ = hamerly.settle(v, centers, *state)
        exact = hamerly.distances(v, centers.rows)
        assert (state[0] == exact.argmin(axis=1)).all()
        centers = hamerly.Centers([[int(x) for x in r + gen.integers(-2, 3, 3)] for r in centers.rows], centers)


def test_bounds_spare_most_scans():
    gen = np.random.default_rng(1)
    v = np.concatenate([gen.normal(m, 1, (200, 8)) for m in (0, 100, 200)]).round()
    centers = hamerly.Centers([[int(x) for x in v[i]] for i in (0, 200, 400)])
    *state, all_of = hamerly.settle(v, centers, None, None, None)
    moved = hamerly.Centers([[int(x) + 1 for x in r] for r in centers.rows], centers)
    assert all_of == 600 and hamerly.settle(v, moved, *state)[3] == 0


def test_rounds_join_without_a_shuffle(spark):
    vectors = hamerly.integer_vectors(spark.createDataFrame(table(), VECTORS), scale=256).where(F.size("v") == 4)
    name = hamerly._kept(hamerly._blocks(vectors, 4).repartition(3, "block"), 3)
    centers = hamerly.Centers([[0] * 4, [256] * 4])
    bounds = hamerly._kept(hamerly._round(spark, name, None, centers, 4), 3)
    plan = hamerly._round(spark, name, bounds, centers, 4)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    storage.dropped(spark, name, bounds)


def brute_negatives(rows, positives=5, k=10, scale=256):
    kept = [(i, [floor_of(x, scale) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seen, out = [], []
    for a in kept:
        if a[0] % 10 or a in seen:
            continue
        seen.append(a)
        scores = sorted((-sum(x * y for x, y in zip(a[1], v)), i, y) for i, v, y in kept if i != a[0] or y != a[2])
        for p, i, _ in [s for s in scores if s[2] == a[2]][:positives]:
            fits = [s for s in scores if s[2] != a[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:k]
            out += [(a[0], i, n, s[1], -p, -s[0]) for n, s in enumerate(fits, 1)]
    return sorted((*r[:4], *(max(-(2**63), min(2**63 - 1, x)) for x in r[4:])) for r in out)


@pytest.mark.parametrize("huge", [False, True])
def test_hard_negatives(spark, monkeypatch, huge):
    rows = table(3, 200)
    if huge:
        rows = [(i, None if v is None else [x if x is None else x * RND.choice([1, 1e9, 1e30]) for x in v], *rest) for i, v, *rest in rows]
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "CELL_ROWS", 64)
    monkeypatch.setattr(hardneg, "CELL_ANCHORS", 8)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_no_negatives(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], "a", 0, "", ""), (0, [1.0], "a", 0, "", ""), (1, [1.0], "b", 0, "", "")], VECTORS)
    assert hardneg.hard_negatives(one, F.col("id") % 10 == 0).collect() == []  # no other row of the label


@given(st.integers(-(10**25), 10**25), st.integers(-(10**25), 10**25))
def test_limits_and_keys(p, s):
    least, most = hardneg.limits(p, 30, 90, 100)
    assert (least <= s <= most) == (30 * p <= 100 * s <= 90 * p)
    assert hardneg.from_down_key(hardneg.down_key(p)) == p and (hardneg.down_key(p) < hardneg.down_key(s)) == (p > s)


TEXTS = [None, "", " \n", "MIT License", "mit\tlicense, MIT-LICENSE mit license", "cc by cc by-sa", "permit licenses mit licensed", "é mit license ü" * 3, "x\x00gnu General public\nlicense\x7fapache license",
         "GNU General Public License" + " word" * 60_000 + " cc by", "K mit license", "SPDX-License-Identifier: MIT OR (GPL-2.0-only AND Apache-2.0)"]


def test_license_base_scan(spark):
    rows = [(i, t, "mine", "other") for i, t in enumerate(TEXTS)] + [(3, "MIT License", "mine", "other"), (None, "mit license", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string, n_words string")
    found = licensescan.find_licenses(docs)
    assert found.columns == ["doc_id", "n_words", "licenses"]
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licensescan.license_digest(found).collect())))
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(n, label) for n in range(len(w)) for phrase, label in licensescan.BASE.items() if w[n : n + len(phrase.split())] == phrase.split()]
        starts = [n for n, _ in at]
        want.append(str((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))))
    assert got == sorted(want)
    assert licensescan.license_digest(licensescan.find_licenses(docs.limit(0))).count() == 0
    for r in licensescan.license_digest(found).collect():
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize("text,said,labels,permits", [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "apache,gpl,mit", 2),
    ("é SPDX-License-Identifier: MIT AND GPL-3.0+ OR ISC\nmore", "MIT AND GPL-3.0+ OR ISC", "gpl,isc,mit", 3),
    ("// spdx-license-identifier:  Own-1.0 and (MIT", "Own-1.0", "own", 0),
    ("License: BSD-3-Clause or LGPL-2.1-or-later.", "BSD-3-Clause or LGPL-2.1-or-later", "bsd,lgpl", 3),
    ("Released under the MPL-2.0. More", "MPL-2.0", "mpl", 2),
    ("a driving license and other papers", None, "", None),
    ("SPDX-License-Identifier: OR", None, "", None),
    ("SPDX-License-Identifier: ((mit))", "((mit))", "mit", 3),
])
def test_license_expressions(spark, text, said, labels, permits):
    row = licensescan.license_digest(licensescan.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    spans = [text[e["start"] : e["end"]] for e in licensescan.scan(text)["expressions"]]
    assert spans == ([said] if said else []) and (row["labels"], row["permission"]) == (labels, permits)


def brute_permission(said):
    """By Python's own grammar: or as max, and as min, with as one step more."""
    def value(x):
        return licensescan.PERMISSION.get(licensescan.family(x), 0)

    code = re.sub(r"([A-Za-z0-9.+-]+) WITH [A-Za-z0-9.+-]+", lambda m: f"V({min(3, value(m[1]) + 1)})", said)
    code = re.sub(r"\b(?!AND\b|OR\b|V\()[A-Za-z][A-Za-z0-9.+-]*", lambda m: f"V({value(m[0])})", code)

    class V:
        def __init__(self, n):
            self.n = n

        def __and__(self, other):
            return V(min(self.n, other.n))

        def __or__(self, other):
            return V(max(self.n, other.n))

    return eval(code.replace("AND", "&").replace("OR", "|"), {"V": V}).n


def test_shunting_yard_equals_a_grammar():
    def make(depth):
        if depth == 0 or RND.random() < 0.3:
            return RND.choice(["MIT", "GPL-2.0-only", "LGPL-2.1+", "CC-BY-SA-4.0", "Odd-1", "GPL-3.0-only WITH Some-exception"])
        return RND.choice(["{} AND {}", "{} OR {}", "({} OR {})", "({} AND {})"]).format(make(depth - 1), make(depth - 1))

    for _ in range(300):
        said = make(4)
        order, n = licensescan.postfix(re.findall(r"[()]|[^\s()]+", said))
        assert n == len(re.findall(r"[()]|[^\s()]+", said)) and licensescan.permission(order) == brute_permission(said)


def test_license_texts_that_repeat_tags():
    for text in ("license " * 30_000, "spdx-license-identifier or " * 20_000, "SPDX-License-Identifier: " + "MIT or " * 30_000, "license: (" * 20_000):
        assert len(licensescan.scan(text)["expressions"]) <= 1
