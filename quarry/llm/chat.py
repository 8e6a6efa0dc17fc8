"""Chat formatting by a grammar round trip.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` per turn. A turn is rendered, the rendering is
reparsed with the deterministic parser of the template, and what comes back is compared with the
source; where it differs, the content is escaped (one backslash more between `<` and `|`) and
the turn is rendered and reparsed again, until both are identical. Reading back takes one backslash
away, so texts that hold control strings or escapes already come back as they were.

Scale: one shuffle by conversation. Turns stream through a task in order, with a running hash and
offset as the only state, so a conversation of any length needs the memory of one turn.

Defined results: null text and role are empty; turns are ordered by turn (nulls first), then role,
then text, so ties and repeated rows have one order; rows with a null conversation id form one
conversation of that id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of

START, END = "<|im_start|>", "<|im_end|>"
_FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(stream: str, at: int = 0) -> tuple[str, str, tuple[int, int], int] | None:
    """The turn that begins at `at`: role, text, the place of the content, and where the turn ends.
    None if no whole turn stands there."""
    if not stream.startswith(START, at):
        return None
    line = stream.find("\n", at)
    close = stream.find("<|", line) if line >= 0 else -1
    if close < 0 or not stream.startswith(END + "\n", close):
        return None
    role = stream[at + len(START) : line]
    return _unescape_role(role), unescape(stream[line + 1 : close]), (line + 1, close), close + len(END) + 1


def render(role: str, text: str) -> str:
    """A turn that the parser reads back as exactly this role and text."""
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        back = parse(out)
        if back and back[:2] == (role, text) and back[3] == len(out):
            return out
    raise AssertionError("the last form always comes back")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, at, begun = None, 0, False
    for batch in batches:
        out: list[tuple] = []
        for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or not begun:
                conv, at, begun = c, 0, True
            made = render(role, text)
            low, high = parse(made)[2] if role == "assistant" else (None, None)
            out.append((c, turn, made, None if low is None else at + low, None if high is None else at + high))
            at += len(made)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])


class _Reader:
    """Reads one conversation back from its formatted stream, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.buffer, self.at, self.turns, self.loss_chars = conv, "", 0, 0, 0
        self.all, self.loss, self.spans = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, piece: str, span: tuple[int, int] | None) -> None:
        self.buffer += piece
        if span:
            self.spans.append(span)
        done = 0
        while got := parse(self.buffer, done):
            role, text, place, end = got
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            while self.spans and self.spans[0][1] <= self.at + end:
                low, high = self.spans.pop(0)
                masked = unescape(self.buffer[low - self.at : high - self.at])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
            done = end
        self.buffer, self.at = self.buffer[done:], self.at + done

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: {len(self.buffer)} characters are no turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.at


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    reader = None
    for batch in batches:
        out: list[tuple] = []
        for conv, piece, low, high in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if reader is None or reader.conv != conv:
                if reader:
                    out.append(reader.row())
                reader = _Reader(conv)
            reader.feed(piece, None if low is None else (low, high))
        if out:
            yield made(out)
    if reader:
        yield made([reader.row()])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn in the order of its conversation: conv_id, turn, formatted, and loss_start
    and loss_end, the code points of the conversation's formatted text on which loss is taken
    (assistant content; null for other roles)."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of format_turns holds, reparsed: one row per conversation with the number and
    SHA-256 of its turns, and the length and SHA-256 of all unescaped text under the loss mask."""
    return formatted.mapInArrow(_read, _READ)
