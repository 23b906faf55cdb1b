"""Chat formatting from event logs: fold each conversation's events, render its turns, mark what the loss covers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import prepare

#: Control strings of the template, fixed
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escaped(text: str) -> str:
    """Text in which no control string is left: each one, escaped or not, gets one backslash more after its first sign."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(messages: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the (start, end) code points of the texts under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body = OPEN + HEAD + escaped(role) + BODY, escaped(text)
        if role == trained:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    return [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(formatted)]


class Fold:
    """The state of one conversation while its events are read in order."""

    def __init__(self) -> None:
        self.order: list[str] = []
        self.role: dict[str, str] = {}
        self.text: dict[str, list[str]] = {}

    def apply(self, kind: str, message: str, role: str, text: str) -> None:
        if kind == "message" or message not in self.text:
            if message not in self.text:
                self.order.append(message)
            self.role[message], self.text[message] = role, [text]
        elif kind == "delta":
            self.text[message].append(text)
        elif kind == "edit":
            self.text[message] = [text]
        elif kind == "regenerate":
            for later in self.order[self.order.index(message) + 1 :]:
                del self.role[later], self.text[later]
            del self.order[self.order.index(message) + 1 :]
            self.text[message] = [text]

    def messages(self) -> list[tuple[str, str]]:
        return [(self.role[m], "".join(self.text[m])) for m in self.order]


SCHEMA = "conv_id long, formatted string, mask array<struct<start:long,end:long>>"


def _fold(batches: Iterator[pa.RecordBatch], trained: str) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        masks = [[{"start": a, "end": b} for a, b in r[2]] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(masks, kind)], ["conv_id", "formatted", "mask"])

    fold, current, begun, rows = Fold(), None, False, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "message_id", "role", "text")]
        for conv, what, message, role, text in zip(*columns, strict=True):
            if begun and conv != current:
                rows.append((current, *render(fold.messages(), trained)))
                fold = Fold()
            current, begun = conv, True
            fold.apply(what or "message", message or "", role or "", text or "")
        if len(rows) >= 500:
            yield out(rows)
            rows = []
    if begun:
        rows.append((current, *render(fold.messages(), trained)))
    if rows:
        yield out(rows)


def reconstruct(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Fold event logs into formatted conversations: conv_id, formatted, mask (code point ranges under the loss).

    events: conv_id, seq, message_id (string), kind, role, text.  In order of seq (ties by message_id, kind, role, text),
    `message` opens a message or replaces it, `delta` appends to it, `edit` replaces its text, and `regenerate` replaces
    its text and drops every message after it; any kind opens a message that is not open.  Null text, role or message_id
    counts as empty, a null kind as message, null conv_ids are one conversation.  Extra columns are ignored; an empty
    log gives an empty result.  Rows are dealt by conversation and sorted, and only the state of the one being read is
    held, which is the size of its output row.
    """
    prepare(events.sparkSession)
    log = events.select("conv_id", "seq", "message_id", "kind", "role", "text")
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "kind", "role", "text")
    return ordered.mapInArrow(lambda it: _fold(it, trained), SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        formatted, masks = batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()
        for text, mask in zip(formatted, masks, strict=True):
            turns = parse(text)
            digest = hashlib.sha256()
            for role, said in turns:
                digest.update(f"{role}\n{said}\n".encode())
            loss = "".join(unescaped(text[m["start"] : m["end"]]) for m in mask)
            rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["conv_id", *names])


def read_back(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are parsed again: digests of their turns and of the loss text."""
    prepare(conversations.sparkSession)
    return conversations.mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as an event log; rows that repeat a turn are turns of their
    own, in table order.

    Each row opens its message with its first half and streams the rest as a delta, so the log is folded like any other.
    """
    half = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), half.alias("half"),
        F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias("message_id"),
    )
    parts = F.array(
        F.struct(F.lit("delta").alias("kind"), F.substring("text", F.lit(1), F.col("half")).alias("text")),
        F.struct(F.lit("delta").alias("kind"), F.substring("text", F.col("half") + 1, F.length("text")).alias("text")),
    )
    return numbered.select("conv_id", "seq", "message_id", "role", F.posexplode(parts).alias("k", "p")).select(
        "conv_id", (F.col("seq").cast("long") * 2 + F.col("k")).alias("seq"), "message_id", "p.kind", "role", "p.text"
    )
