"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

`format_turns` streams each conversation in turn order through the machine and emits, for each turn, its text
segments with a loss flag each. `read_back` is the inverse: it needs nothing but the segments.

Control strings cannot be forged: inside roles and texts every `<`, backslashes, `|` gets one backslash more, so
no escaped text holds the first two characters of a marker; removing one backslash undoes it.

Scale: one shuffle by conversation, then an external sort; the machine and the digests carry their state from
row to row, so a conversation of any length passes through in bounded memory. Its turns stay in one task, since a
running digest cannot be split.

Defined cases: null text or role counts as empty, an unknown role is formatted and makes the conversation
invalid; equal turn numbers are ordered by role, then text; repeated rows are turns of their own; a null conv_id
is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import _arrow_schema

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles bear loss, and which role may follow which."""

    opening: str = "<|im_start|>"
    role_end: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = ""
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn in pieces; the loss piece is the escaped text and nothing else."""
        return [(f"{self.opening}{escape_role(role)}{self.role_end}", False), (escape(text), role in self.loss_roles), (self.closing, False)]

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        head, sep, rest = formatted.removeprefix(self.opening).partition(self.role_end)
        if not formatted.startswith(self.opening) or not sep or not rest.endswith(self.closing):
            raise ValueError("not a formatted turn")
        return unescape_role(head), unescape(rest.removesuffix(self.closing))


TURNS = "conv_id long, position long, segments array<struct<text: string, loss: boolean>>, state string, allowed boolean"


def format_turns(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """TURNS, in order within each partition. state: the machine's after the turn; allowed: whether its role may stand there."""
    template = template or Template()
    arrow = _arrow_schema(rows.sparkSession, TURNS)
    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, state = object(), 0, template.start
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, position, state = conv, 0, template.start
                allowed = role in template.follows.get(state, ())
                state = role
                out.append({"conv_id": conv, "position": position, "segments": [{"text": t, "loss": x} for t, x in template.segments(role, text)], "state": state, "allowed": allowed})
                position += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, TURNS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, from the segments of `format_turns` in the order in which it emits them."""
    template = template or Template()
    arrow = _arrow_schema(turns.sparkSession, READ)

    class Conversation:
        def __init__(self, conv: int | None) -> None:
            self.conv, self.turns, self.loss, self.chars, self.valid, self.state = conv, 0, 0, 0, True, template.start
            self.turns_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

        def add(self, segments: list[dict], state: str, allowed: bool) -> None:
            formatted = "".join(s["text"] for s in segments)
            role, text = template.parse(formatted)
            self.turns_digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for s in segments:
                if s["loss"]:
                    plain = unescape(s["text"])
                    self.loss += len(plain)
                    self.loss_digest.update(plain.encode("utf-8", "surrogatepass"))
            self.turns, self.chars, self.state, self.valid = self.turns + 1, self.chars + len(formatted), state, self.valid and allowed

        def row(self) -> dict:
            return {"conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.turns_digest.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.loss_digest.hexdigest(), "formatted_chars": self.chars, "valid": self.valid and self.state in template.final}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for r in b.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    done += [now.row()] if now else []
                    now = Conversation(r["conv_id"])
                now.add(r["segments"], r["state"], r["allowed"])
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema=arrow)

    return turns.mapInArrow(run, READ)
