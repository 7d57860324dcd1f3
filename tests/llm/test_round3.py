"""Repeated rows in number, ids that are no numbers, capital rule hosts, logs of whole chats, short and signed secrets, jobs of the join."""

import random
import re
import string

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat, decontam, jaccard, secretscan, sharding, urlfilter
from tests.llm.test_llm import BASE, edited, prose

RND = random.Random(33)
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_equal_rows_are_dealt(spark, doc_id):
    rows = [(doc_id, "one text", i) for i in range(4000)] + [(i, prose(3), -i) for i in range(50)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, own int"), bucket_bytes=2000).collect()
    assert sorted(str((r["doc_id"], r["text"], r["own"])) for r in out) == sorted(map(str, rows))
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(0.02 * sum(sizes) / 8, max(r["size"] for r in out))
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_ids_that_are_no_numbers(spark):
    item = prose(30)
    texts = [BASE[4], edited(BASE[4], 1), BASE[5], item + " " + prose(20), prose(40), None, ""]
    docs = spark.createDataFrame([(f"id-{9 - i}", t, "s", i) for i, t in enumerate(texts)], "doc_id string, text string, source string, n int")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs.select("doc_id", "text")).collect()}
    assert got["id-9"] == got["id-8"] == "id-8" and got["id-7"] == "id-7" and len(got) == 7
    found = decontam.contaminated(docs.select("doc_id", "text"), spark.createDataFrame([("item", item)], "item_id string, text string"))
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in found.collect()] == [("id-6", "item", 1.0)]
    kept = jaccard.keep_first(docs, jaccard.jaccard_components(docs.select("doc_id", "text")))
    left = decontam.without(kept, found)
    shards = corpus_pipeline.shards(spark, corpus_pipeline.mix(spark, left, ""), "")
    assert {r["doc_id"] for r in shards.collect()} <= {"id-8", "id-7", "id-5", "id-4", "id-3"}


def test_capital_rule_hosts(spark):
    pages = spark.createDataFrame([(1, "http://www.EXAMPLE.org/A"), (2, "http://other.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("Example.Org", "/A", "block"), ("example.org", "/A", "block")], urlfilter.RULE_SCHEMA)
    assert sorted((r["page_id"], r["rule"]) for r in urlfilter.judge_urls(pages, rules).collect()) == [(1, "example.org/A"), (2, None)]


def test_a_log_of_deltas_edits_and_regenerations(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "héllo <turn>"), ("assistant", ""), (None, None), ("assistant", "x" * 9), ("assistant", "a\\b"), ("user", "q")])]
    rows += [(1, 3, "assistant", "x" * 9), (None, None, "user", "nobody"), (2, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.as_log(turns)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    by_log = sorted(map(str, chat.format_conversations(log).collect()))
    assert by_log == sorted(map(str, chat.format_conversations(chat.as_events(turns)).collect()))
    assert chat.as_log(turns.limit(0)).count() == 0


KINDS = {"A-Z": string.ascii_uppercase, "a-z0-9": string.ascii_lowercase + string.digits, "base62": string.ascii_letters + string.digits,
         "base32": string.ascii_uppercase + "234567", "HEX": string.digits + "ABCDEF", "base64": string.ascii_letters + string.digits + "+/",
         "signs": string.ascii_letters + string.digits + "!@#$%^&*"}


@pytest.mark.parametrize("size", [12, 15, 20, 32, 40])
@pytest.mark.parametrize("kind", KINDS)
def test_random_keys_are_found(kind, size):
    hits = 0
    for _ in range(200):
        key = RND.choice(string.ascii_uppercase) + "".join(RND.choices(KINDS[kind], k=size - 2)) + RND.choice(string.ascii_uppercase)
        text = f"we saw {key} there"
        base = secretscan.base_spans(text)
        covered = {i for s, _, e in base + secretscan.random_spans(text, base, RANKS) for i in range(s, e)}
        hits += len(covered & set(range(7, 7 + size))) >= 0.9 * size
    assert hits >= 180


def test_what_is_no_secret():
    key = "9F86D081884C7D659A2FEAA0C55AD015"
    for text in (f"MD5 checksum: {key}", "getElementById", "utm_source=google&utm_medium=email", "wonderful!!!!!!!!!!!!!!!!", "$$$misunderstanding$$$", "2024-01-02-2025-03-04", "----------------"):
        assert not secretscan.random_spans(text, secretscan.base_spans(text), RANKS), text
    assert secretscan.random_spans(key, secretscan.base_spans(key), RANKS)
    assert not secretscan.random_spans("zX9qP2mK7vR4", [], RANKS, least=13) and secretscan.random_spans("zX9qP2mK7vR4", [], RANKS)


def test_jobs_of_the_join(spark):
    """No job counts rows before a join: documents without links end in a bounded number of jobs (91 before, 63 on the smallest tables)."""
    docs = spark.createDataFrame([(i, prose(60)) for i in range(60)], "doc_id long, text string")
    status = spark.sparkContext.statusTracker()
    before = max(status.getJobIdsForGroup(None), default=-1)
    jaccard.jaccard_components(docs, 3, 90, 100).count()
    assert max(status.getJobIdsForGroup(None)) - before <= 75
