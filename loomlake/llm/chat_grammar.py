"""Chat formatting by grammar round trip.

Grammar of a formatted conversation:

    conversation := turn*          turn := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Control strings cannot stand inside a role or text: there a "<" and "|" have at least one backslash between them, and a
role has "\\n" as backslash, n. Rendering starts with the source as it is. A deterministic parser reads the output back;
where the recovered turns differ from the source, the conflicting turns are escaped and the output is parsed again,
until both are identical. Escaping adds one backslash between "<" and "|", reading takes one away, so it is reversible.

Rows are read turn by turn from sorted partitions, so a conversation of any length needs the memory of one turn. Order
in a conversation: turn (null first), role, text. Null role or text: empty. A null conv_id is a conversation of its own.
Repeated rows are repeated turns, and rows that tie in turn stand by role and text, so the output does not depend on how
they come; very long texts are one turn, whole; an empty table gives an empty table. Other columns, of whatever name, are
not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class GrammarError(ValueError):
    pass


def escape(s: str) -> str:
    return _CONTROL.sub(r"<\\\1|", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def _turn(formatted: str, at: int) -> tuple[str, str, int, int, int]:
    """(role, text, start and end of the text in the output, place behind) of the turn that begins at a place."""
    if not formatted.startswith(START, at):
        raise GrammarError(f"no turn at {at}")
    at += len(START)
    line = formatted.find("\n", at)
    end = formatted.find("<|", at)
    if line < 0 or end < line or not formatted.startswith(END + "\n", end):
        raise GrammarError(f"turn not closed at {at}")
    return unescape_role(formatted[at:line]), unescape(formatted[line + 1 : end]), line + 1, end, end + len(END) + 1


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text in the output) of each turn; the texts are unescaped."""
    out, at = [], 0
    while at < len(formatted):
        *turn, at = _turn(formatted, at)
        out.append(tuple(turn))
    return out


class Reader:
    """The parser over output that comes in parts of any length: it holds what has no end yet, one turn at most."""

    def __init__(self):
        self.rest, self.seen = "", 0

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        """The turns that this part completes, with the places of their texts in the whole output."""
        self.rest += part
        at = 0
        # a turn is complete when its closing line is there; a control string cannot stand inside it
        while (close := self.rest.find(END + "\n", at)) >= 0:
            role, text, a, b, behind = _turn(self.rest, at)
            if behind != close + len(END) + 1:
                raise GrammarError(f"turn not closed at {self.seen + at}")
            yield role, text, self.seen + a, self.seen + b
            at = behind
        self.rest, self.seen = self.rest[at:], self.seen + at

    def close(self) -> None:
        if self.rest:
            raise GrammarError(f"turn not closed at {self.seen}")


def _read(segment: str) -> list[tuple[str, str]] | None:
    try:
        return [(r, t) for r, t, _, _ in parse(segment)]
    except GrammarError:
        return None


def format_turn(role: str, text: str) -> str:
    """The turn rendered so that the parser recovers it. Turns close themselves, so this holds for conversations too."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        if _read(segment := render(r, t)) == [(role, text)]:
            return segment
    raise GrammarError("no rendering is read back as the source")


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: the spans of assistant texts in it."""
    out = "".join(format_turn(r, t) for r, t in turns)
    got = parse(out)
    if [(r, t) for r, t, _, _ in got] != list(turns):
        raise GrammarError("the conversation is not read back as the source")
    return out, [(a, b) for r, _, a, b in got if r == "assistant"]


def ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    out = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(df: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, turn, formatted, is_loss): the formatted segments of every conversation, in order within partitions."""

    def run(rows):
        for b in batches(rows):
            conv, turn, role, text = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([format_turn(r, t) for r, t in zip(role, text)], pa.string()), pa.array([r == "assistant" for r in role])], ["conv_id", "turn", "formatted", "is_loss"])

    return ordered(df, **columns).mapInArrow(run, "conv_id long, turn long, formatted string, is_loss boolean")


class _Digest:
    """A conversation rendered turn by turn, its output read back by one parser from begin to end."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.source = conv, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.reader = Reader()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str) -> None:
        self.source.update(f"{role}\n{text}\n".encode())
        segment = format_turn(role, text)
        self.chars += len(segment)
        for got_role, got, _, _ in self.reader.feed(segment):
            self.n += 1
            self.turns.update(f"{got_role}\n{got}\n".encode())
            if got_role == "assistant":
                self.loss.update(got.encode())
                self.loss_chars += len(got)

    def row(self):
        self.reader.close()
        if self.turns.digest() != self.source.digest():
            raise GrammarError(f"conversation {self.conv} is not read back as the source")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(df: DataFrame, **columns: str) -> DataFrame:
    """What the parser reads back from the formatted output of each conversation."""

    def run(rows: Iterator[pa.RecordBatch]):
        now = None
        for b in batches(rows):
            done = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGESTS)], schema=_DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), _DIGESTS)], schema=_DIGESTS)

    return ordered(df, **columns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
