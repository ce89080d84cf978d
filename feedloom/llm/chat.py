r"""Operator 3: chat formatting.

A declarative template names the marks around a turn and, as a finite-state
machine, which role may follow which.  ``format_turns`` streams the turns of
each conversation in order through that machine and emits, per turn, the
formatted text with its segments ``(start, end, loss)``; the formatted
conversation is the concatenation of its turns.  ``read_back`` is the inverse:
it scans the formatted text alone for marks and the segments for the loss
mask, and returns one row per conversation with digests.

Control strings inside texts are escaped reversibly.  Every mark starts with
``<|``.  Escaping puts one more backslash between ``<`` and ``|`` wherever a
text has ``<``, any backslashes, ``|``; unescaping takes one away.  After it
no text contains ``<|``.  In role names, backslash and newline are escaped as
``\\`` and ``\n``, since a newline ends the role.

Both steps keep the state of one conversation (a few numbers and hashers) and
pass over sorted rows, so a conversation of any length is never held whole.

Defined cases: null texts and roles count as empty; turns sort by number with
nulls first, ties by role and text; repeated rows are turns like any other;
rows without conv_id form one conversation; a role the machine does not expect
makes the conversation invalid (``valid`` false) but it is formatted all the
same; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the machine over roles, and the roles whose text
    counts for the loss.  ``moves[state]`` lists the roles allowed next; the
    state after a turn is its role, and a role that was not expected leads to
    its own state too."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    moves: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss_roles: tuple = ("assistant",)

    def __post_init__(self):
        if not (self.open.startswith("<|") and self.close.startswith("<|")) or self.open == self.close:
            raise ValueError("marks must differ and start with '<|'")

    def allows(self, state: str, role: str) -> bool:
        return role in self.moves.get(state, ())


CHAT = Template()
_PIPE = re.compile(r"<(\\*)\|")
_UNPIPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PIPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNPIPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """The text segments of one turn with their loss flags."""
    return [(f"{template.open}{escape_role(role)}\n", False),
            (escape(text), role in template.loss_roles),
            (f"{template.close}\n", False)]


FORMATTED = "conv_id long, turn_no long, formatted string, segments array<struct<start:long,end:long,loss:boolean>>, valid boolean"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))


def format_turns(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per turn (conv_id, turn, role, text): its number in the
    conversation, formatted text, segments in code points, and whether the
    machine accepted every turn so far.  Rows of a conversation lie in one
    partition, in order."""
    def run(batches):
        conv, state, no, valid, begun = None, "start", 0, True, False
        for b in batches:
            out = []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                role, text = role or "", text or ""
                if not begun or c != conv:
                    conv, state, no, valid, begun = c, "start", 0, True, True
                valid = valid and template.allows(state, role)
                state = role
                at, spans, parts = 0, [], segments(template, role, text)
                for s, loss in parts:
                    spans.append({"start": at, "end": at + len(s), "loss": loss})
                    at += len(s)
                out.append((c, no, "".join(s for s, _ in parts), spans, valid))
                no += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), _SEGMENTS, pa.bool_()))],
                    names=["conv_id", "turn_no", "formatted", "segments", "valid"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
                        F.col("turn").cast("long").alias("turn_"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, FORMATTED))


class _Reader:
    """Reads one formatted conversation piece by piece; pieces end with turns."""

    def __init__(self, template: Template):
        self.t, self.turns, self.chars, self.loss_chars = template, 0, 0, 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.valid = True

    def feed(self, formatted: str, spans: list[dict], valid: bool) -> None:
        self.chars += len(formatted)
        self.valid = self.valid and valid
        at = 0
        while at < len(formatted):
            if not formatted.startswith(self.t.open, at):
                raise ValueError("a turn does not begin with its mark")
            role_end = formatted.index("\n", at)
            end = formatted.index(self.t.close + "\n", role_end + 1)
            role = unescape_role(formatted[at + len(self.t.open):role_end])
            text = unescape(formatted[role_end + 1:end])
            self.digest.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            at = end + len(self.t.close) + 1
        for s in spans:
            if s["loss"]:
                text = unescape(formatted[s["start"]:s["end"]])
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv):
        return (conv, self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read from the output of ``format_turns``
    (whose partitions and order it relies on): turns, their digest, the text
    under the loss mask, length, validity."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, valid boolean")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [f.split()[0] for f in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        conv, reader = None, None
        for b in batches:
            out = []
            for c, no, text, spans, valid in zip(*(b.column(i).to_pylist() for i in range(5))):
                if reader is None or no == 0:
                    if reader is not None:
                        out.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.feed(text, spans, valid)
            if out:
                yield batch(out)
        if reader is not None:
            yield batch([reader.row(conv)])

    return formatted.mapInArrow(run, schema)
