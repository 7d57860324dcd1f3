"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from quillspark.llm import chat, decontam, jaccard, kernels, mixing, secretscan, sharding, tokencount, topk, toxicity, urlfilter

RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choices("abcdefgh", k=RANDOM.randint(2, 6))) for _ in range(400)]
WORD = r"[^\x20\x09-\x0D]+"


def prose(n):
    return " ".join(RANDOM.choices(WORDS, k=n))


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def edited(text, n):
    w = text.split(" ")
    for i in RANDOM.sample(range(len(w)), n):
        w[i] = RANDOM.choice(WORDS)
    return " ".join(w)


BASE = [prose(n) for n in (3, 8, 20, 60, 120, 200, 400)]
TEXTS = ([None, "", " \t\n", "One", "one", "a b", "A  B", "a\x85b c", "x" * 70000, prose(30000)] + BASE + BASE[3:] + [b.upper() for b in BASE]
         + [edited(b, max(1, len(b.split()) // k)) for b in BASE[2:] for k in (200, 90, 40, 25, 15, 8) for _ in range(3)])
ROWS = [(i, t, "en", RANDOM.choice(["s0", "s0", "s1", "s2", None]), -1) for i, t in enumerate(TEXTS)] + [(2, "", "en", "s1", 0), (16, BASE[6], "en", "s0", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernel_words():
    got = []
    for _, data, offsets in kernels.segments(pa.array(TEXTS), 1000):
        got += [len(s) for s in kernels.shingle_sets(data, offsets, 3)]
    assert got == [len(shingles(t, 3)) for t in TEXTS]


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {(i, len(s), root(i)) for i, ss in sets.items() for s in ss}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard(docs, n, num, den):
    got = jaccard.jaccard_components(docs.select("doc_id", "text"), n, num, den)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == brute_components(ROWS, n, num, den)


def test_pigeonhole_loses_no_link():
    t = jaccard.Threshold(8, 10)
    gen = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(gen.integers(0, 2**63, int(gen.integers(1, 300)), dtype=np.uint64))
        y = np.unique(np.append(x[gen.random(len(x)) > 0.1], gen.integers(0, 2**63, int(len(x) * gen.random() * 0.12), dtype=np.uint64)))
        if len(y) and t.linked(x, y) and not np.array_equal(x, y):
            assert set(jaccard.bucket_keys(x, t)) & set(jaccard.bucket_keys(y, t))
            assert np.bitwise_count(jaccard.folded(x) ^ jaccard.folded(y)).sum() <= t.differ(len(x), len(y))


@pytest.mark.parametrize("num,den", [(8, 10), (90, 100)])
@pytest.mark.parametrize("size", [5, 8, 20, 60, 150, 400, 1000, 5000, 20000])
def test_unrelated_sets_share_no_bucket(num, den, size):
    t, gen, n = jaccard.Threshold(num, den), np.random.default_rng(size), 60
    keys = [set(jaccard.bucket_keys(np.sort(gen.integers(0, 2**63, size, dtype=np.int64).view(np.uint64)), t).tolist()) for _ in range(n)]
    assert sum(bool(a & b) for a, b in itertools.combinations(keys, 2)) <= n * n / 2000


def test_buckets_in_cells(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 3)
    got = jaccard.jaccard_components(docs.select("doc_id", "text"), 3, 90, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(ROWS, 3, 90, 100)


def test_components_of_chains(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("9000", "9001"), ("9001", "9000")]
    got = dict(jaccard.components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert set(got.values()) == {"0000", "9000"} and len(got) == 63


def test_roots_of_trees(spark):
    rng = random.Random(7)
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(100)]
    bushes = [(f"{rng.randrange(i):03}", f"{i:03}") for i in range(201, 400) if i % 11]
    parent = {b: a for a, b in chain + bushes}

    def top(x):
        return top(parent[x]) if x in parent else x

    got = jaccard.trees(spark.createDataFrame(chain + bushes, "a string, b string")).collect()
    assert len(got) == len({x for e in chain + bushes for x in e})
    assert all(r["root"] == top(r["node"]) for r in got)
    assert jaccard.trees(spark.createDataFrame([], "a string, b string")).count() == 0


def test_keep_first(docs):
    kept = jaccard.keep_first(docs, jaccard.jaccard_components(docs.select("doc_id", "text"), 5, 8, 10)).collect()
    least = {c for _, n, c in brute_components(ROWS, 5, 8, 10) if n}
    assert sorted(r["doc_id"] for r in kept if words(r["text"])) == sorted(least)
    assert sum(not words(r["text"]) for r in kept) == 4


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v")], "doc_id long, text string")
    found = jaccard.jaccard_components(df, 3, 8, 10)
    assert sorted((r["component_id"] is None, r["component_id"] or 0) for r in found.collect()) == [(False, 5)] * 3 + [(True, 0)] * 2
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_first(df, found).collect()) == [0, 5]


def shard_laws(rows, n):
    assert {r["shard"] for r in rows} <= set(range(n))
    for s in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards(spark, docs):
    many = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else prose(RANDOM.randint(1, 60)), "en", "s", 0) for i in range(3000)], SCHEMA)
    rows = sharding.shard_by_bytes(many, 8, bucket_bytes=20_000).collect()
    shard_laws(rows, 8)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8 and all(r["size"] == len(r["text"]) + 1 for r in rows)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(many.repartition(7), 8, bucket_bytes=20_000).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    odd = sharding.shard_by_bytes(docs, 8).collect()
    shard_laws(odd, 8)
    assert len(odd) == len(ROWS)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
        free -= over
        left = sum(sizes.values()) - sum(target.values())


def test_mix(spark, docs):
    some = spark.createDataFrame([(i, prose(RANDOM.choice([1, 5, 20, 300])), "en", f"s{i % 17 if i % 3 else 0}", 0) for i in range(4000)], SCHEMA)
    for df in (some, docs):
        rows = mixing.mix_sources(df).collect()
        sizes = {}
        for r in rows:
            assert r["size"] == len(re.findall(WORD, r["text"] or "")) and 0 <= r["copies"] <= 3
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        want = brute_targets(sizes)
        for s in sizes:
            taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == s)
            assert {round(r["target"], 3) for r in rows if r["source"] == s} == {round(want[s], 3)}
            if df is some:
                assert abs(taken - want[s]) <= 0.01 * want[s] + 300
    again = mixing.mix_sources(some.repartition(5)).select("doc_id", "copies").collect()
    assert sorted(again) == sorted(mixing.mix_sources(some).select("doc_id", "copies").collect())
    out = mixing.emit(mixing.mix_sources(docs, prefix="__m_"), docs.columns, "__m_copies")
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} <= {-1, 0, 1}


def test_topk(spark):
    gen = np.random.default_rng(1)
    rows = [(i, [float(x) for x in gen.normal(size=8)]) for i in range(700)] + [(i, [0.5] * 8) for i in range(700, 900)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (905, []), (1000, [3e5] * 8), (100, [0.25] * 8)]
    rows += [(1100, [3e38, -1e30] * 4), (1101, [1e17, 2.0]), (1102, [3e38, -1e30, 3e38, 0.0]), (1200, [-3e38] * 8), (1103, [1e9] * 8)]  # beyond 2^52 and 2^63
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    got = topk.top_k(vectors, F.col("id") % 100 == 0).collect()
    good = [(r["id"], [int(x) for x in r["v"]]) for r in vectors.collect()]
    top, want = 2**63 - 1, set()
    for q, v in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q)
        want |= {(q, n + 1, c, max(-top - 1, min(top, -s))) for n, (s, c) in enumerate(scores[:10])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(vectors.where("id < 0"), F.col("id") >= 0).count() == 0


def test_blocks_are_pruned():
    gen = np.random.default_rng(2)
    centres = gen.normal(size=(20, 16)) * 300
    vectors = np.floor(np.repeat(centres, 256, axis=0) + gen.normal(size=(5120, 16)) * 10)
    blocks = [(np.arange(i, i + 256), vectors[i : i + 256]) for i in range(0, 5120, 256)]
    ends = [f([v for _, v in blocks], axis=1) for f in (np.max, np.min)]
    scored = topk.search_blocks(vectors[:4], np.arange(4), blocks, *ends, topk._Best(4, 10))
    assert scored < 4 * 20 / 2
    high = topk._Best(4, 10, np.full(4, 1e18))  # a threshold found elsewhere
    assert topk.search_blocks(vectors[:4], np.arange(4), blocks, *ends, high) == 0


@given(st.lists(st.integers(-(2**80), 2**80) | st.integers(-300, 300), max_size=30))
def test_down_keys_sort(numbers):
    assert sorted(numbers, key=topk.down_key) == sorted(numbers, reverse=True)


def test_toxicity(spark):
    bad = ["vile", "nasty"]
    rows, labels = [], []
    for i in range(3000):
        toxic = RANDOM.random() < 0.15
        rows.append((i, prose(30) + (f" {RANDOM.choice(bad)}. " + prose(5) if toxic else ""), "en", "s", 0))
        if RANDOM.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df.withColumn("held", toxicity.fold(F.col("doc_id")) == 0), model).collect()
    held = [r for r in got if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [r["predicted"] == int(any(b in r["text"] for b in bad)) for r in held]
    assert sum(right) / len(right) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    flipped = lab.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.fit(df, flipped)
    assert np.array_equal(other[0], model[0]) and np.array_equal(other[1], model[1]) and other[2] == model[2]


def test_toxicity_odd_inputs(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (3, 1, None), (4, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_risk_stays_non_negative():
    gen = np.random.default_rng(0)
    sets = [np.unique(gen.integers(1, 60, 10, dtype=np.uint64)) for _ in range(80)]
    assert toxicity.train(sets[:40], [], 0.1)[2] == -np.inf
    hashes, weights, bias = toxicity.train([np.append(s, np.uint64(99)) for s in sets[:40]], sets[40:], 0.2)
    assert weights[hashes == 99][0] > 0 and np.isfinite(bias)


def test_decontamination(spark, empty):
    items = [(i, prose(RANDOM.randint(25, 50)).capitalize() + ".") for i in range(30)] + [(30, "too short"), (31, None)]
    rows, want = [], set()
    for i in range(300):
        body = prose(RANDOM.randint(5, 80))
        if i % 5 == 0:
            item = items[i % 30][1]
            w = item.split()
            for at in RANDOM.sample(range(len(w)), len(w) * (i % 4) // 20):
                w[at] = "zzz"
            body += "\n" + " | ".join(w).upper() + "\n" + prose(20)
            want.add((i, i % 30))
        rows.append((i, body, "en", "s", 0))
    rows += [(400, items[0][1], "en", "s", 0)] * 2 + [(401, None, "en", "s", 0), (402, "", "en", "s", 0)]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want | {(400, 0)}
    left = decontam.without(df, found)
    assert left.columns == df.columns and left.count() == len(rows) - 60 - 2
    for a, b in ((empty, bench), (df, bench.limit(0))):
        assert decontam.contaminated(a, b).count() == 0


def test_decontamination_hot_passage(spark):
    item = [f"w{i}" for i in range(20)]
    hot = " ".join("zz" if i in (3, 7, 11, 16) else w for i, w in enumerate(item))  # few of its seeds stand, all of these in each document
    rows = [(i, f"{prose(6)} {hot} {prose(6)}" if i % 2 else prose(20)) for i in range(2400)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontam.contaminated(df, bench)
    assert sorted((r["doc_id"], r["similarity"], r["start"], r["end"]) for r in found.collect()) == [(i, 0.7, 6, 26) for i in range(1, 2400, 2)]
    assert decontam.without(df, found).count() == 1200


def test_seed_slices(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEED_SLICE", 40)
    items = [(i, prose(30)) for i in range(8)]
    df = spark.createDataFrame([(i, prose(10) + " " + t + " " + prose(10)) for i, t in items], "doc_id long, text string")
    found = decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(8)} and all(r["start"] == 10 and r["end"] == 40 for r in found)


def brute_align(p, q):
    h = np.zeros((len(q) + 1, len(p) + 1), dtype=int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == p[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_decontamination_reaches_share(spark):
    def changed(w):
        w = list(w)
        for _ in range(RANDOM.randint(0, max(1, len(w) // 2))):
            at, how = RANDOM.randrange(len(w)), RANDOM.choice("sid")
            w[at : at + 1] = {"s": ["zz"], "i": [w[at], "zz"], "d": [] if len(w) > 1 else w}[how]
        return w

    items = [[f"i{i}w{k}" if k % 3 else f"c{(i + k) % 5}" for k in range(n)] for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 12, 15, 15, 16, 20, 20, 27, 31] * 2)]
    texts = [[f"x{j}"] * 3 + changed(items[j % 32]) + [f"c{j % 5}"] * 2 + changed(items[j * 7 % 32]) for j in range(600)]
    spread = [w for k in range(15) for w in (items[9][k], "zz")]  # one edit after each word
    texts += [["zz" if k in (3, 7, 11) else w for k, w in enumerate(items[9])], spread]
    df = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for share in (0.5, 0.8):
        want = {}
        for (j, p), (i, q) in itertools.product(enumerate(texts), enumerate(items)):
            if len(set(p) & set(q)) >= min(len(set(q)), max(1, share * len(q) / 3)):  # no fewer words can reach the share here
                score = brute_align(np.array(p), np.array(q)) / (2 * len(q))
                if score >= (1 if len(q) < 4 else share):
                    want[j, i] = score
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench, share).collect()}
        assert got == want and (share > 0.5 or {(600, 9), (601, 9)} <= set(want))


def test_alignment():
    gen = np.random.default_rng(4)
    pairs = [(gen.integers(1, 6, gen.integers(1, 40), dtype=np.uint64), gen.integers(1, 6, gen.integers(1, 25), dtype=np.uint64)) for _ in range(60)]
    got = decontam.align([a for a, _ in pairs], [b for _, b in pairs])
    assert [s for s, *_ in got] == [brute_align(a, b) for a, b in pairs]
    assert all(0 <= s <= e <= len(a) for (_, s, e), (a, _) in zip(got, pairs))


@pytest.mark.parametrize("hot", [200_000, 40, 0])
def test_tokens(spark, docs, monkeypatch, hot):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "HOT", hot)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = [" ", "  ", "\n", "a", "Word", "1", ".", "'s", "é", "\u3000", "\xa0", "<|endoftext|>", "\x1c", "\x85", "中", "ª", "\u0378", "\U0001f600", "²", "'"]
    odd = ["".join(RANDOM.choices(pieces, k=12)) for _ in range(2000)] + [prose(30_000), "x" * 5000]
    more = spark.createDataFrame([(i, t, "n_tokens", "row", 7, i) for i, t in enumerate(odd)], "doc_id long, text string, lang string, row string, bytes int, n_tokens long")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["row"], r["bytes"]) for r in tokencount.token_counts(more, path).collect()}
    assert got == {(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids), "row", 7) for i, t in enumerate(odd)}
    got = [tuple(r) for r in tokencount.token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS]
    assert sorted(got) == sorted((*x, x[2] > 1024) for x in want)
    assert {"lang", "source", "size"} <= set(tokencount.token_counts(docs, path).columns)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens_of_other_kinds(docs, name):
    path = public_tokenizers.path(name)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(docs, path).collect())
    assert got == sorted((i, tokencount.counter(path)([t or ""])[0]) for i, t, *_ in ROWS)


def brute_secrets(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets(spark):
    parts = ["password: ", "Token=", "api_key", "apikey = '", "\"secret\" : \"", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "deadbeef", " ", "\n", "é", "=", "xyz_", "ſecret=", "abcdefghijklm", ".-/+", "tokens"]
    texts = ["".join(RANDOM.choices(parts, k=14)) for _ in range(3000)] + [None, "", "x" * 50000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = secretscan.secret_digest(secretscan.find_secrets(df, public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()
    for r in got:
        base = brute_secrets(texts[r["doc_id"]] or "")
        said = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == said


def test_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def kinds(t):
        return [t[s:e] for s, _, e in secretscan.random_spans(t, [], path)]

    assert kinds("key zX9qP2mK7vR4tY8wL3nB6cJ5 end") == ["zX9qP2mK7vR4tY8wL3nB6cJ5"]
    assert kinds("d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000 my_long_variable_name_42 12345678901234567890 plainlowercasewordsinarow") == []


def test_random_strings_of_all_classes():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rnd, low, up, digits = random.Random(8), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    least = {up + "234567": 0.98, low + digits: 0.94, up + digits: 0.94, low + up + digits: 0.98, low + up: 0.98, up: 0.94, low: 0.8}
    for letters, share in least.items():
        for size in (16, 20, 32):
            keys = ["".join(rnd.choices(letters, k=size)) for _ in range(300)]
            assert sum(secretscan.random_spans(f"key {k} end", [], path) == [(4, 3, 4 + size)] for k in keys) >= share * 300
    plain = """getElementsByTagNameNS MAXIMUM_BUFFER_SIZE_BYTES XMLHttpRequestEventTarget internationalization 1990-01-01/2000-12-31
        4111-1111-1111-1111 /usr/local/lib/python3/dist-packages ==================== 2024-01-02-release-notes 1-2-3-4-5-6-7-8-9-10"""
    assert secretscan.random_spans(plain, [], path) == []
    assert secretscan.random_spans("JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP", [], path) == [(0, 3, 32)]


def test_chat(spark, empty):
    ev = [("c", 1, "message", "1", "user", "hi <turn>"), ("c", 2, "message", "2", "assistant", "a"), ("c", 3, "delta", "2", None, "b\\"), ("c", 4, "edit", "1", None, "Hi"),
          ("c", 5, "regenerate", "2", None, None), ("c", 6, "delta", "2", None, "new"), ("c", 7, "delta", "2", None, " one </turn>\n"), ("c", 8, "message", "3", "user", None),
          ("c", 9, "delete", "3", None, None), ("c", 9, "odd kind", "9", None, "x"), ("c", 10, "delta", "4", "assistant", "late"), (None, 1, "message", "1", None, None)]
    df = spark.createDataFrame(ev, "conv_id string, seq long, kind string, message_id string, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    want = [("user", "Hi"), ("assistant", "new one </turn>\n"), ("assistant", "late")]
    assert chat.read_turns(got["c"]["formatted"]) == want and chat.read_turns(got[None]["formatted"]) == [("", "")]
    assert [chat.unescape(got["c"]["formatted"][s["start"] : s["end"]]) for s in got["c"]["loss_spans"]] == [t for r, t in want if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_round_trip():
    marks = ["\\", "<", ">", "</turn>", "<turn user>\n", "\n", "a", "é", "\\### Assistant: </turn> ok"]
    for _ in range(2000):
        turns = [(RANDOM.choice(["user", "assistant", "r>\n<"]), "".join(RANDOM.choices(marks, k=RANDOM.randint(0, 8)))) for _ in range(3)]
        text, mask = chat.render(turns)
        assert chat.read_turns(text) == turns and "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), (None, "/", "block"), ("com", "/fr/", "allow")]
    urls = [None, "no scheme", "http://A.Example.ORG/es/x?q", "https://example.org/en/12#f", "https://example.org", "https://xorg/", "http://a.b.com/fr/", "http://com/fr", "a://b://c/d", "http://org/é", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls)], "page_id int, url string, host string")
    rows = urlfilter.judge_urls(pages, spark.createDataFrame(rules, urlfilter.RULE_SCHEMA)).collect()
    assert len(rows) == len(urls) * 2
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"] % len(urls)] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best[1:])
    assert urlfilter.judge_urls(pages, spark.createDataFrame([], urlfilter.RULE_SCHEMA)).where("verdict = 'allow'").count() == len(rows)


def test_empty_tables(empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert jaccard.jaccard_components(empty.select("doc_id", "text")).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert tokencount.token_counts(empty, path).count() == 0
    assert secretscan.find_secrets(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as p

    extra = [(1000 + i, prose(40) + " vile", "en", "s1", 0) for i in range(0, 60)]
    extra += [(1100, prose(30) + " " + BASE[4] + " " + prose(30), "en", "s2", 0)] + [(1200 + i, prose(50), "en", f"s{i % 3}", 0) for i in range(300)]
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 1060)) for i in range(1000, 1500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, BASE[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = df
    for name, stage in p.STAGES:
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert not ids & set(range(1000, 1060)) and set(range(1200, 1500)) <= ids
        if name == "near_duplicates":
            assert set(range(1200, 1500)) <= ids
        if name == "decontaminate":
            assert 1100 not in ids and set(range(1200, 1500)) <= ids
        assert name == "shards" or out.columns == df.columns
        seen = out
    rows = seen.collect()
    shard_laws(rows, 8)
    assert len(rows) == p.run(spark, str(tmp_path)).count()
