"""Chat formatting by event-sourced reconstruction: fold the log of each conversation, then render its messages.

Events, by ``seq``: ``message`` opens a message with an id, ``delta`` appends to the last message of that id, ``edit``
replaces its text, ``regenerate`` empties it for the deltas to come, ``delete`` removes it. A delta, edit or regeneration of
an unknown id opens the message; events of other kinds and deletions of unknown ids change nothing. Ties of ``seq`` go by
kind (a message first), id, role and text; a null ``seq`` comes first. Null texts and roles are empty; a null conversation id is a conversation.

Rendered, a turn is ``<turn ROLE>``, a line break, the text, a line break and ``</turn>``. Inside roles and texts a backslash
goes before each ``\\``, ``<`` and ``>``, so no text can hold a mark and ``read_turns`` gets back what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

EVENT_COLUMNS = ("conv_id", "seq", "kind", "message_id", "role", "text")
_ESCAPED = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>\n([^\\<>]*(?:\\.[^\\<>]*)*)\n</turn>\n", re.S)


def escape(s: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the final messages; events: (kind, message id, role, text) in order."""
    messages: list[list] = []  # [role, parts], None where deleted
    last: dict = {}
    for kind, key, role, text in events:
        at = last.get(key)
        if kind == "message" or at is None and kind in ("delta", "edit", "regenerate"):
            last[key] = len(messages)
            messages.append([role or "", [text or ""]])
        elif at is None:
            continue
        elif kind == "delta":
            messages[at][1].append(text or "")
        elif kind == "edit":
            messages[at][1] = [text or ""]
        elif kind == "regenerate":
            messages[at][1] = [text or ""]
        elif kind == "delete":
            messages[at] = None
            del last[key]
    return [(m[0], "".join(m[1])) for m in messages if m]


def render(messages: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it, in code points, that carry loss: the texts of role ``trained``."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body, tail = f"<turn {escape(role)}>\n", escape(text), "\n</turn>\n"
        if role == trained:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn. Raises ValueError unless the whole string is turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_conversations(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans (array of start and end, code points).

    The log is dealt by conversation and sorted by sequence; a task folds it as it streams by and holds one conversation,
    whole texts however long. conv_id may be of any type that sorts. Repeated events count each, in the order of the
    ties; an empty log gives no conversations. Columns other than ``EVENT_COLUMNS`` describe events and are not carried over.
    """
    order = F.when(F.col("kind") == "message", 0).otherwise(1)
    events = events.select(*EVENT_COLUMNS, order.alias("rank"))
    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "rank", "kind", "message_id", "role", "text")
    schema = dealt.select("conv_id").withColumn("n_turns", F.lit(0).cast("long")).withColumn("formatted", F.lit("")).withColumn(
        "loss_spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).schema
    key_type = to_arrow_type(dealt.schema["conv_id"].dataType)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for batch in batches:
            for conv, _, kind, key, role, text, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and conv != now:
                    yield now, fold(iter(held))
                    held = []
                now = conv
                held.append((kind, key, role, text))
        if held:
            yield now, fold(iter(held))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        convs, turns, texts, masks = zip(*rows, strict=True)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans = [[{"start": a, "end": b} for a, b in m] for m in masks]
        columns = [pa.array(convs, key_type), pa.array(turns, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "formatted", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, messages in conversations(batches):
            text, mask = render(messages, trained)
            rows.append((conv, len(messages), text, mask))
            size += len(text)
            if size > 1 << 22:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    return dealt.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say, from the formatted text and the loss mask alone.

    One row a row of ``formatted``, repeated ones each; raises ValueError where a text is not whole turns.
    """
    schema = formatted.select("conv_id").withColumns(
        {"n_turns": F.lit(0).cast("long"), "turns_sha256": F.lit(""), "loss_chars": F.lit(0).cast("long"), "loss_sha256": F.lit(""),
         "formatted_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text, turns_hash, loss_hash, loss = text.as_py(), hashlib.sha256(), hashlib.sha256(), 0
                turns = read_turns(text)
                for role, said in turns:
                    turns_hash.update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    loss += len(said)
                    loss_hash.update(said.encode())
                rows.append((len(turns), turns_hash.hexdigest(), loss, loss_hash.hexdigest(), len(text)))
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.name for f in schema.fields])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


def as_log(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as the log of a chat that came to them.

    Rows of a conversation are numbered by turn, role and text (nulls first, null roles and texts empty), repeated ones each.
    By their number in turn, a message is streamed as two deltas; opens as a draft that an edit replaces; or is
    streamed wrongly, regenerated and streamed again. The draft is the text backwards. Very long texts are cut in halves of
    code points; other columns take no part; an empty table gives an empty log.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right, draft = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text")), F.reverse("text")

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    streamed = [event("delta", left), event("delta", right)]
    told = F.when(F.col("n") % 3 == 0, F.array(event("message", F.lit("")), *streamed)).when(
        F.col("n") % 3 == 1, F.array(event("message", draft), event("edit", F.col("text")))).otherwise(
        F.array(event("message", F.lit("")), event("delta", draft), event("regenerate", F.lit("")), *streamed))
    log = rows.select("conv_id", "n", "role", F.posexplode(told).alias("step", "event"))
    return log.select("conv_id", (F.col("n") * 8 + F.col("step")).alias("seq"), "event.kind", F.col("n").cast("string").alias("message_id"), "role", "event.text")


def as_events(conversations: DataFrame, text: Column | None = None) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log of one message event a row.

    Null roles and texts become empty, null turns come first; repeated rows are an event each, texts of any length stay whole,
    other columns take no part, and an empty table gives an empty log.
    """
    text = F.col("text") if text is None else text
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("string").alias("message_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
