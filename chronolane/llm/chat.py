"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Each turn becomes text segments with a loss flag.  Control strings of the template inside a turn's
text are broken by an escape character, so the formatted text can be parsed back to the same turns.

Scale: rows are dealt by conversation and sorted within partitions, then streamed through one pass;
a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """open, close: the marks around a role's text; other roles are marked by ``other`` with the name inside.

    moves: the roles that may follow each state; states are "start" and the roles.  ends: roles that
    may come last.  loss: roles whose text counts for the loss.
    """

    open: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"})
    close: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({*self.open.values(), *self.close.values(), *self.other}, key=lambda s: (-len(s), s))


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        marks = "|".join(map(re.escape, template.controls()))
        self._marks = re.compile(marks)
        self._break = re.compile(f"{ESCAPE}|(?={marks})(.)", re.S)
        self._mend = re.compile(f"{ESCAPE}([01])")
        self._opens = {v: k for k, v in template.open.items()}

    def escape(self, text: str) -> str:
        """No control string is left in the result, and unescape() gives the text back."""
        return self._break.sub(lambda m: f"{m[1]}{ESCAPE}1" if m[1] else f"{ESCAPE}0", text)

    def unescape(self, text: str) -> str:
        return self._mend.sub(lambda m: ESCAPE if m[1] == "0" else "", text)

    def error(self, roles: list[str | None]) -> str | None:
        """Why the order of roles isn't accepted; None if it is."""
        state = "start"
        for k, role in enumerate(roles):
            if role not in self.template.moves.get(state, ()):
                return f"turn {k}: {role} after {state}"
            state = role
        return None if state in self.template.ends else f"ends in {state}"

    def segments(self, turns: list[tuple[str | None, str | None]]) -> Iterator[Segment]:
        """Marks and texts in order; only the text of loss roles is flagged, not the marks around it."""
        t = self.template
        for role, text in turns:
            body = self.escape(text or "")
            if role in t.open:
                yield Segment(t.open[role], False)
                yield Segment(body, role in t.loss)
                yield Segment(t.close[role], False)
            else:
                yield Segment(f"{t.other[0]}{self.escape(role or '')}{t.other[1]}{body}{t.other[2]}", False)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        t, turns, at = self.template, [], 0
        while at < len(text):
            opened = self._marks.match(text, at)
            if not opened:
                raise ValueError(f"no turn begins at {at}")
            role, at = self._opens.get(opened[0]), opened.end()
            if role is None:
                middle = text.index(t.other[1], at)
                role, at = self.unescape(text[at:middle]), middle + len(t.other[1])
                close = t.other[2]
            else:
                close = t.close[role]
            end = text.index(close, at)
            turns.append((role, self.unescape(text[at:end])))
            at = end + len(close)
        return turns


_RESULT = "n_turns long, formatted string, segments array<struct<text:string,loss:boolean>>, error string"


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template | None = None) -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, segments (text, loss) and error (null: accepted order).

    Turns are ordered by (turn, role, text), nulls first, so ties give one result; a null text counts as
    empty and a null role as a role named "".  Conversations with an order the machine refuses are
    formatted too and carry the reason.  Rows with a null conversation id form one conversation.  Extra
    columns are ignored; an empty input gives an empty result.
    """
    kind = rows.schema[conv].dataType.simpleString()
    ordered = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    chosen = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, names = Formatter(chosen), ["conv", "n_turns", "formatted", "segments", "error"]
        held: list[tuple] = []

        def done(found: list[tuple], types: pa.DataType) -> pa.RecordBatch:
            out: list[tuple] = []
            for key, turns in found:
                parts = list(maker.segments(turns))
                out.append((key, len(turns), "".join(p.text for p in parts), [{"text": p.text, "loss": p.loss} for p in parts], maker.error([r for r, _ in turns])))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            shapes = [types, pa.int64(), pa.string(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, s) for c, s in zip(cols, shapes, strict=True)], names)

        key, turns, some, types = None, [], False, None
        for batch in batches:
            types = batch.schema.field(0).type
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if some and c != key:
                    held.append((key, turns))
                    turns = []
                    if len(held) >= 500:
                        yield done(held, types)
                        held = []
                key, some = c, True
                turns.append((r, t))
        if some:
            yield done([*held, (key, turns)], types)

    return ordered.mapInArrow(run, f"conv {kind}, {_RESULT}").withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id", template: Template | None = None) -> DataFrame:
    """Per conversation what its formatted text holds: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256: lowercase hex over role, "\\n", text, "\\n" of each turn.  loss_*: over the unescaped
    text under the loss flags alone.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    chosen = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Formatter(chosen)
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = maker.parse(text)
                whole = hashlib.sha256()
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode())
                lost = "".join(maker.unescape(p["text"]) for p in parts if p["loss"])
                rows.append((len(turns), whole.hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            shapes = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, s) for c, s in zip(cols, shapes, strict=True))], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    found = formatted.select(F.col(conv).alias("conv"), "formatted", "segments")
    return found.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
