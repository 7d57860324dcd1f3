"""Secret scans: fixed patterns, and random strings that a tokenizer's vocabulary packs badly.

Prose and identifiers hold several characters a token; keys and passwords hold few. All runs of key characters are counted,
whatever they consist of; those without letters by their digits alone, as separators cut dates and numbers into many tokens.
Runs with a low ratio count as spans of kind ``random``, unless they are known digests (hex of a digest's length behind a digest's name, UUIDs),
identifiers (words that the vocabulary packs well, joined by separators or capitals), or overlap a span that a pattern found.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillspark.llm.storage import fresh

KINDS = ("assign", "access", "hex", "random")
LEAST_RUN = 12  # characters of a run that the token test looks at; a parameter of ``find_secrets``
MOST_RATIO = 2.0  # characters a token below which a run is random
MIXED_RATIO = 2.2  # the same for runs that mix letters of a case with others, digits or signs, and for long ones
LONG_RUN = 24
SHORT_RATIO = 1.85  # the same for runs of letters alone under ``SHORT_RUN`` characters, which rare words resemble
SHORT_RUN = 16
WORD_RATIO = 3.0  # characters a token that the words of an identifier hold at least

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short can't hold a longer one
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/=_-](?:[A-Za-z0-9+/=_!@#$%^&*-]*[A-Za-z0-9+/=_-])?")  # signs of prose around it are not of it
_SEPARATORS = re.compile(r"[+/=_!@#$%^&*-]+")
_NAMED = re.compile(r"(?:md5|sha|tiger|digest|checksum|hash|commit|etag|fingerprint)[^\n]{0,24}$", re.I)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})  # hex digits of MD5, SHA-1, Tiger and the SHA-2 and SHA-3 sizes
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")


@cache
def vocabulary(path: str):
    """The tokenizer of a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("scan", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})


def is_digest(run: str, before: str) -> bool:
    """A UUID, or hex of a digest's length that the text right before it calls a digest."""
    return bool(_UUID.fullmatch(run)) or (len(run) in DIGEST_LENGTHS and bool(_DIGEST.fullmatch(run)) and bool(_NAMED.search(before)))


def most_ratio(run: str) -> float:
    """A first capital and signs at the ends mix nothing, as in prose."""
    kinds = any(map(str.islower, run)) + any(map(str.isupper, run[1:])) + any(map(str.isdigit, run)) + bool(re.search("[!@#$%^&*]", run))
    if kinds > 1 or len(run) >= LONG_RUN:
        return MIXED_RATIO
    return MOST_RATIO if len(run) >= SHORT_RUN else SHORT_RATIO


def is_identifier(run: str, path: str) -> bool:
    """Words of three letters on average or more that the vocabulary packs well in lower case, with short numbers between,
    joined by signs or capitals."""
    parts = [p for piece in _SEPARATORS.split(run) for p in _PART.findall(piece)]
    if sum(map(len, parts)) < len(_SEPARATORS.sub("", run)):
        return False
    words = [p.lower() for p in parts if p.isalpha()]
    size = sum(map(len, words))
    return bool(words) and size >= 3 * len(parts) and size >= WORD_RATIO * sum(len(vocabulary(path).encode_ordinary(w)) for w in words)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, leftmost non-overlapping per kind, in code points."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], path: str, least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
    found = []
    starts, reach = sorted(s for s, _, _ in base), []
    for _, _, e in sorted(base):
        reach.append(max(e, reach[-1] if reach else 0))  # how far the spans up to here go
    for m in _RUN.finditer(text):
        run = m[0]
        if len(run) < least:
            continue
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        counted = run if re.search("[A-Za-z]", run) else re.sub("[^0-9]", "", run)
        if not counted or len(counted) >= most_ratio(run) * len(vocabulary(path).encode_ordinary(counted)):
            continue
        if not is_digest(run, text[max(0, m.start() - 40) : m.start()]) and not is_identifier(run, path):
            found.append((m.start(), 3, m.end()))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, path: str, text: str = "text", least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end), instead of the text; ``path``: the vocabulary;
    ``least``: the length from which a run of key characters is tested.

    Null texts count as empty and, as texts without secrets, get an empty array. Repeated rows each keep theirs. Whole texts are
    read, one at a time, however long. All other columns stay, whatever their names; one named ``secrets`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in {"secrets", text.lower()}]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh("text", docs)))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("secrets", T.DataType.fromDDL(
        "array<struct<kind:string,start:bigint,end:bigint>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(kept)):
                t = value.as_py() or ""
                base = base_spans(t)
                spans = sorted(base + random_spans(t, base, path, least))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(span))], names=[*kept, "secrets"])

    return source.mapInArrow(run, schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the ``secrets`` column of ``find_secrets``, by DataFrame functions.

    Empty arrays, as of null, empty and clean texts, have counts 0 and the digest of an empty string; repeated rows each keep
    theirs, other columns are left out, an empty table stays empty.
    """
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
