"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Each distinct (host, path) expands into ``host suffix + path prefix`` strings, one prefix for each length that a rule's
path has; ``#``, which neither can hold, stands between the two. Rules and expressions meet on the first ``PREFIX_BITS`` bits of SHA-256; a hit counts only when the whole digests
agree. Of all rules that fit a URL the longest wins; at one length the longer host, then ``block`` before ``allow``.
DataFrame functions only. The rule table is broadcast when it has at most ``BROADCAST_RULES`` rows and ``BROADCAST_BYTES``
of text, else it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.storage import BROADCAST_BYTES, bytes_of, small_enough, written

RULE_SCHEMA = "host string, path string, verdict string"
BROADCAST_RULES = 100_000
BROADCAST_FOUND = 200_000
PREFIX_HEX = 8


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame) -> DataFrame:
    digest = F.sha2("expression", 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row (host, path, rule, verdict) for each distinct (host, path) of ``urls`` that some rule fits.

    A rule's path may begin with any character; its host never reaches into the path and, as those of urls, counts in lower
    case. Null parts disable a rule; repeated rules and urls count once; very long ones are read whole; other columns take no part;
    an empty table on either side gives no rows.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    facts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.sum(bytes_of(rules)).alias("bytes")).first()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.array(*[F.lit(n) for n in sorted(facts["lengths"])]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expanded = (
        urls.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("start", F.explode(prefixes))
        .select("host", "path", F.concat("suffix", F.lit("#"), "start").alias("expression"))
    )
    book = _keyed(
        rules.select(
            F.concat("host", F.lit("#"), "path").alias("expression"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_length"),
            F.col("verdict").alias("rule_verdict"),
        )
    )
    if facts["n"] <= BROADCAST_RULES and (facts["bytes"] or 0) <= BROADCAST_BYTES // 4:  # each text stands in it about twice
        book = F.broadcast(book)
    e, r = _keyed(expanded).alias("e"), book.alias("r")
    hits = e.join(r, F.col("e.prefix") == F.col("r.prefix")).where(F.col("e.digest") == F.col("r.digest"))
    best = F.max(
        F.struct(F.length("r.expression"), F.col("r.host_length"), F.col("r.rule_verdict") == "block",
                 F.col("r.rule").alias("rule"), F.col("r.rule_verdict").alias("verdict"))
    )
    hits = hits.groupBy("e.host", "e.path").agg(best.alias("best"))
    return hits.select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced.

    No rule fits: rule null, verdict ``default``. Null or odd urls: empty host and path, which only an empty rule host
    fits. Repeated pages each keep their row; null parts of a rule disable it; an empty rule table leaves the default. Urls
    are read whole, however long. All other columns stay, whatever their names. The rules found are a table, so that a
    (host, path) of very many pages, as that of all odd urls, can be split when pages join it.
    """
    named = {"host", "path", "rule", "verdict"} - {url}
    kept = [c for c in pages.columns if c.lower() not in named]
    pages = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url}`")).alias("host"),
                         url_path(F.col(f"`{url}`")).alias("path"))
    found = small_enough(written(matched_rules(pages, rules), "url-rules"), BROADCAST_FOUND)
    return pages.join(found, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
