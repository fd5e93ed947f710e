"""Conversations as training text: a finite-state machine over roles, a declarative template, and a loss flag for each segment.

Rows are dealt by conversation and sorted by turn; one streaming pass per partition holds a turn at a time, so a conversation of any length passes. Control strings of the template can't occur inside texts: each `<`, any number of backslashes and `|` in a text gets one backslash more, which reading takes away again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import columns


@dataclass(frozen=True)
class Template:
    """What stands around a turn, who speaks after whom, and whose text is learnt."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    after: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})


CHATML = Template()
ROWS = 4096  # segments in a batch


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _segments(batches: Iterator[pa.RecordBatch], t: Template) -> Iterator[pa.RecordBatch]:
    """(conv_id, role, text) in order to (conv_id, segment, text, loss, valid). valid: the machine has taken all turns so far."""
    now, state, valid, no, out = (None, False), "", True, 0, []
    names = ["conv_id", "segment", "text", "loss", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        size = 0
        for row in range(batch.num_rows):
            conv, role, text = (batch.column(k)[row].as_py() for k in range(3))
            role, text = role or "", text or ""
            if now != (conv, True):
                now, state, valid, no = (conv, True), "", True, 0
            valid = valid and role in t.after.get(state, ())
            state = role
            for piece, loss in ((t.opening + _escape_role(role) + t.after_role, False), (escape(text), role in t.loss), (t.closing, False)):
                out.append((conv, no, piece, loss, valid))
                no += 1
            size += len(text)
            if len(out) >= ROWS or size > 8 << 20:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def format_chat(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """The segments of all conversations (conv_id, turn, role, text), in order within each partition: conv_id, segment, text, loss, valid. Concatenated, a conversation's segments are its training text.

    Turns go by turn, nulls first; ties by role, then text. A null role or text is empty; an unknown or misplaced role is formatted too and makes valid false from there on. Rows with a null conv_id are one conversation. Repeated rows are turns of their own. A turn of any length is one segment; a conversation is one task's, which streams it a turn at a time. Further columns are ignored, whatever their names. No rows give no segments."""
    own = columns(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return own.mapInArrow(lambda batches: _segments(batches, template), "conv_id long, segment long, text string, loss boolean, valid boolean")


class _Reading:
    """What has been read of a conversation."""

    def __init__(self, conv: int | None, t: Template):
        self.conv, self.t, self.rest, self.turns, self.chars, self.loss_chars, self.valid = conv, t, "", 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest += text
        while (end := self.rest.find(self.t.closing)) >= 0:
            head, self.rest = self.rest[:end], self.rest[end + len(self.t.closing) :]
            if not head.startswith(self.t.opening):
                raise ValueError("a turn doesn't begin with the opening mark")
            role, _, body = head[len(self.t.opening) :].partition(self.t.after_role)
            self.turns += 1
            self.all.update(f"{_unescape_role(role)}\n{unescape(body)}\n".encode())

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("text after the last closing mark")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _digests(batches: Iterator[pa.RecordBatch], t: Template) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    reading, out = None, []
    for batch in batches:
        for conv, no, text, loss, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if no == 0:
                out += [reading.row()] if reading else []
                reading = _Reading(conv, t)
            reading.take(text, loss, valid)
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    out += [reading.row()] if reading else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parses formatted conversations, segments in the order of format_chat, into a row each: conv_id, n_turns, digests of turns and of what is under the loss mask, lengths, valid. No segments give no rows; turns of any length are read a segment at a time."""
    return segments.mapInArrow(lambda batches: _digests(batches, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
