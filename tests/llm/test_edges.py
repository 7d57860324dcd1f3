"""Plain versions of what has no SQL, and odd tables: clashing names, repeated rows, nulls, very long texts."""

import datetime
import decimal
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, decontam, jaccard, kernels, mixing, secretscan, sharding, tokencount, topk, toxicity, urlfilter
from quillspark.llm.storage import small_enough
from tests.llm.test_llm import BASE, brute_align, brute_components, brute_targets, prose, shard_laws, words

RND = random.Random(21)
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# names that operators have used, or use, for columns of their own
NAMES = ["key", "__key", "text_key", "__text", "__copy", "copy", "copies", "size", "c0", "x_score", "__size", "h", "d", "bin", "bucket", "inside", "order", "group", "row", "rest", "class"]
CLASH = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", " ", "one", prose(40), prose(25_000), BASE[4], BASE[4], prose(50) + " vile " + prose(5)]
    rows = [(i if t is not None else None, t, ["a", None, "b"][i % 3], *[f"mine {i} {n}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5], CLASH)


def held(rows, replaced=()):
    return sorted(str((r["doc_id"], r["text"] if "text" in r else None, *[r[n] for n in NAMES if n not in replaced])) for r in rows)


def test_clashing_names(spark, clashing):
    rows = clashing.collect()
    model = toxicity.fit(clashing, spark.createDataFrame([(4, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int"))
    assert held(toxicity.score(clashing, model).collect()) == held(rows)
    assert held(sharding.shard_by_bytes(clashing).collect(), ["size"]) == held(rows, ["size"])
    mixed = mixing.mix_sources(clashing).collect()
    assert held(mixed, ["size", "copies"]) == held(rows, ["size", "copies"])
    for r in mixed:
        assert r["size"] == len(words(r["text"] or ""))
    out = mixing.emit(mixing.mix_sources(clashing, prefix="p_"), clashing.columns, "p_copies")
    assert set(held(out.collect())) <= set(held(rows)) and out.columns == clashing.columns
    none = spark.createDataFrame([], "doc_id long, text_key long, item_id long, similarity double, start long, end long")
    assert held(decontam.without(clashing, none).collect()) == held(rows)
    kept = jaccard.keep_first(clashing, jaccard.jaccard_components(clashing.select("doc_id", "text"))).collect()
    assert set(held(kept)) <= set(held(rows)) and len(kept) == len(rows) - 3
    found = secretscan.find_secrets(clashing, RANKS)
    assert [c for c in found.columns if c != "secrets"] == [c for c in clashing.columns if c != "text"] and found.count() == len(rows)
    vectors = clashing.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert topk.top_k(topk.integer_vectors(vectors), F.col("id") == 3).count() == 8  # the repeated row of the query is none
    pages = clashing.withColumn("url", F.lit("http://a.org/" + "x" * 100_000)).withColumn("rule", F.lit("mine"))
    judged = urlfilter.judge_urls(pages, spark.createDataFrame([("org", "/", "block")], urlfilter.RULE_SCHEMA))
    assert held(judged.collect()) == held(rows) and judged.where("rule = 'org/' and verdict = 'block'").count() == len(rows)
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame([("org", "/", "block")], urlfilter.RULE_SCHEMA)).count() == 0


def test_rule_hosts_end_where_they_end(spark):
    pages = spark.createDataFrame([(1, "http://comx/"), (2, "http://com/x/")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "x/", "block"), ("com", "/x", "block")], urlfilter.RULE_SCHEMA)
    assert sorted((r["page_id"], r["rule"]) for r in urlfilter.judge_urls(pages, rules).collect()) == [(1, None), (2, "com/x")]


@pytest.mark.parametrize("value,kind", [(3, "short"), (decimal.Decimal("1.50"), "decimal(5,2)"), (datetime.date(2020, 1, 2), "date"), ("a", "string"), (7, "bigint")])
def test_conversation_ids(spark, value, kind):
    rows = [(value, 1, "message", "1", "user", "x" * 200_000, "extra"), (value, 1, "message", "1", "user", "x" * 200_000, "extra"), (None, 1, "message", "1", None, None, "extra")]
    log = spark.createDataFrame(rows, f"conv_id {kind}, seq long, kind string, message_id string, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(log).collect()}
    assert got[value]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(log)).count() == 2


def test_random_spans_keep_off_long_spans():
    text = "token=" + ".".join(["0123456789abcdef" * 1] * 4 + ["zX9qP2mK7vR4tY8wL3nB6cJ5"])
    base = secretscan.base_spans(text)
    assert (0, 0, len(text)) in base and secretscan.random_spans(text, base, RANKS) == []


def test_random_spans_of_prose_and_of_repeated_rows(spark):
    plain = [prose(2000) for _ in range(20)]
    assert not any(secretscan.random_spans(t, [], RANKS) for t in plain)
    df = spark.createDataFrame([(1, "key zX9qP2mK7vR4tY8wL3nB6cJ5", "x")] * 3, "doc_id long, text string, secrets string")
    assert [[s["kind"] for s in r["secrets"]] for r in secretscan.find_secrets(df, RANKS).collect()] == [["random"]] * 3


def plain_risk(sets, w, b, prior, n_p):
    """The same objective, text by text."""
    def loss(z):
        return math.log1p(math.exp(-z))

    z = [sum(w[i] for i in s) + b for s in sets]
    positive, unlabelled = z[:n_p], z[n_p:]
    hit = prior * sum(map(loss, positive)) / n_p
    clean = sum(loss(-x) for x in unlabelled) / len(unlabelled) - prior * sum(loss(-x) for x in positive) / n_p
    return hit, clean


def test_risk_is_the_plain_one():
    gen = np.random.default_rng(4)
    sets = [np.unique(gen.integers(0, 6, gen.integers(0, 5))) for _ in range(40)]
    parts = []
    for group in (sets[:15], sets[15:]):
        parts.append((len(group), np.repeat(np.arange(len(group)), [len(s) for s in group]), np.concatenate(group)))
    for _ in range(20):
        w, b = gen.normal(size=6), float(gen.normal())
        hit, clean, d_hit, d_clean = toxicity.risk(*parts, w, b, 0.3)
        assert (hit, clean) == pytest.approx(plain_risk(sets, w, b, 0.3, 15))
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            up, down = (plain_risk(sets, w + s * step[:6], b + s * step[6], 0.3, 15) for s in (1, -1))
            assert [d_hit[i], d_clean[i]] == pytest.approx([(u - d) / 2e-6 for u, d in zip(up, down)], abs=1e-6)


def plain_mix(rows):
    """doc -> copies: documents in order, expected copies summed up, one offset, once for each integer crossed."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"] or ""))
    targets, out = brute_targets(sizes), []
    for s in sizes:
        def place(r):
            n, digest = len(words(r["text"] or "")), hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
            bits = f"{n:b}"
            return len(bits) * 16 + (n >> max(len(bits) - 4, 0)), digest[0], digest, n

        rate = math.floor(targets[s] * (1 << 20) / sizes[s]) if sizes[s] else 0
        offset = int(hashlib.md5(f"mix-offset:{0 if s is None else 1}{s or ''}".encode()).hexdigest()[:5], 16)
        for i, r in enumerate(sorted((r for r in rows if r["source"] == s), key=place)):
            out += [r["doc_id"]] * (((i + 1) * rate + offset >> 20) - (i * rate + offset >> 20))
    return sorted(out, key=str)


def test_broadcasts_are_bounded(spark):
    """By rows and by bytes of text, binary and array columns; nulls and empty tables weigh nothing."""
    df = spark.createDataFrame([("a" * 10, b"b" * 10, [1, 2]), (None, None, None)], "`a.b` string, c binary, d array<long>")

    def hinted(df, *most):
        return "ResolvedHint" in small_enough(df, *most)._jdf.queryExecution().analyzed().toString()

    assert hinted(df, 2, 36) and not hinted(df, 2, 35) and not hinted(df, 1, 36)
    assert hinted(df.limit(0), 0, 0)


def test_mix_by_groups_of_any_number(spark, monkeypatch):
    rows = [(i, prose(7) if i % 3 else "one text of all", ["a", "b", None][i % 7 % 3]) for i in range(1500)]
    df, counts = spark.createDataFrame(rows, "doc_id long, text string, source string"), []
    for most in (1_000_000, 3):
        monkeypatch.setattr(mixing, "GROUP_ROWS", most)
        counts.append(sorted(map(tuple, mixing.mix_sources(df).select("doc_id", "copies").collect())))
    assert [mixing.group_digits(n) for n in (0, 48, 49, 768, 769)] == [1, 1, 2, 2, 3]
    assert counts[0] == counts[1]
    assert [i for i, n in counts[0] for _ in range(n)] == sorted(plain_mix(df.collect()))


def test_probes_are_bounded(spark, monkeypatch):
    for targets, brackets in ((1, 1), (7, 1), (65_535, 1), (65_535, 4096), (65_535, 65_535), (1 << 22, 1 << 20)):
        bits = sharding.probe_bits(targets, brackets)
        assert bits >= 1 and brackets << bits <= max(sharding.MOST_PROBES, 2 * brackets)
    assert sharding.probe_bits(65_535, 1) == 20 and sharding.probe_bits(7, 1) == 12
    texts = ["hot"] * 900 + [f"hot {i % 40}" for i in range(900)] + [prose(9) for _ in range(900)]
    df, out = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    for most in (sharding.MOST_PROBES, 256):
        monkeypatch.setattr(sharding, "MOST_PROBES", most)
        out.append(sorted(map(tuple, sharding.shard_by_bytes(df, 8, bucket_bytes=700).select("doc_id", "shard", "slot").collect())))
    assert out[0] == out[1]


def test_long_frequent_pre_tokens_are_sent(spark, monkeypatch):
    long = ["x" * 33, "=" * 80, "\n" * 64, "é" * 32, "é" * 33]
    rows = [(i, f"{long[i % 5]} word{i} {long[i % 3]}") for i in range(400)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    met, hottest = [], tokencount._hottest
    monkeypatch.setattr(tokencount, "HOT", 50)
    monkeypatch.setattr(tokencount, "_hottest", lambda *x: met.append(hottest(*x)) or met[-1])
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    hot, cold = met[0]
    assert {tokencount._name(" " * (i > 0) + u) for i, u in enumerate(["=" * 80])} <= set(hot) and max(map(len, hot)) == 64
    assert cold.agg(F.max("freq")).first()[0] < 16
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(i, tokencount.counter(path)([t])[0]) for i, t in rows}


def test_pipeline_by_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [None, "", "  ", "one two", *BASE, BASE[5], BASE[6] + " tail", *(prose(60) + " vile" for _ in range(40)), *(prose(RND.randint(5, 90)) for _ in range(120))]
    texts += [prose(30) + " " + BASE[4] + " " + prose(20), prose(20) + " " + " ".join(BASE[3].split()[:50]), prose(20_000)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[9], (None, None, None, None, None), (None, prose(20), None, None, None)]
    vile = [i for i, t in enumerate(texts) if "vile" in (t or "")]
    at = {n: f"{tmp_path}/{n}.parquet" for n in ("labels", "benchmark")}
    spark.createDataFrame([(i, 1, int(i in vile)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(at["labels"])
    items = [(1, BASE[4]), (2, BASE[3]), (3, None), (None, "solo")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(at["benchmark"])
    docs, steps = spark.createDataFrame(rows, schema), dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        before = docs.collect()
        out = steps[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return before, docs.collect()

    def ids(some):
        return sorted((r["doc_id"] for r in some), key=str)

    hashes, weights, bias = toxicity.fit(docs, spark.read.parquet(at["labels"]))
    weight = dict(zip(hashes.tolist(), weights.tolist(), strict=True))

    def said(t):
        h, _ = kernels.word_hashes(np.frombuffer((t or "").encode(), dtype=np.uint8), np.array([0, len((t or "").encode())]), kernels.IS_LETTER)
        return sum(weight.get(x, 0.0) for x in set(h.tolist())) + bias

    before, after = run("toxicity")
    assert ids(after) == ids(r for r in before if said(r["text"]) < 0)
    assert not {r["doc_id"] for r in after} & set(vile) and len(after) >= len(before) - len(vile) - 2
    before, after = run("near_duplicates")
    numbered = [(i, r["text"]) for i, r in enumerate(sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"])))]
    first = {i for i, n, least in brute_components(numbered, 5, 8, 10) if i == least or not n}
    order = sorted((r["doc_id"] for r in before), key=lambda x: (x is None, x))
    assert ids(after) == sorted((order[i] for i in first), key=str)
    before, after = run("decontaminate")

    def tokens(t):
        return re.findall(r"[a-z0-9]+", (t or "").lower())

    bad = [r for r in before if any(len(tokens(i)) >= 4 and brute_align(tokens(r["text"])[:3000], tokens(i)) >= len(tokens(i)) for _, i in items)]
    solo = [r for r in before if "solo" in tokens(r["text"])]
    assert bad and ids(after) == ids(r for r in before if r not in bad and r not in solo)
    before, after = run("mix")
    assert ids(after) == plain_mix(before)
    before, after = run("shards")
    assert ids(before) == ids(after) and all(r["size"] == len((r["text"] or "").encode()) + 1 for r in after)
    shard_laws(after, 8)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
