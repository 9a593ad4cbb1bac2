"""Chat formatting by a finite-state machine over roles, from a declarative template, and the reader of its output.

A text may hold any string, also the template's own marks. A mark inside a text gets a backslash after its first character
and a backslash is doubled, so that no mark is left in it and the reader gets the text back. Turns are written as rows:
segments with a loss flag each, whose texts joined in turn order are the formatted conversation.
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
    """Marks around a role's text, which texts bear loss, and the order of turns.

    ``turns`` has (opening, closing, loss) by role; exactly one role may have no opening. ``other`` is for roles that it
    doesn't name: opening, a mark after the role's name, closing. ``follows`` has the roles that may follow each state;
    states are the roles and ``start``; ``ends`` has the states in which a conversation is whole.
    """

    turns: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("", "</s>", True),
    })
    other: tuple = ("[TURN]", "[AS]", "[/TURN]")
    extra: tuple = ("<s>",)
    follows: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple = ("assistant",)

    def marks(self) -> list[str]:
        own = [m for opening, closing, _ in self.turns.values() for m in (opening, closing) if m]
        return sorted({*own, *self.other, *self.extra}, key=lambda m: (-len(m), m))


class Formatter:
    """One template's compiled rules."""

    def __init__(self, template: Template):
        self.template = template
        marks = "|".join(map(re.escape, template.marks()))
        self.escaped = re.compile(rf"\\|{marks}")
        self.any_mark = re.compile(marks)
        self.slashes = re.compile(r"\\(\\?)")

    def escape(self, text: str) -> str:
        return self.escaped.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self.slashes.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments in order; joined, they are its formatted text."""
        if role in self.template.turns:
            opening, closing, loss = self.template.turns[role]
            parts = [(opening, False), (self.escape(text), loss), (closing, False)]
        else:
            opening, after, closing = self.template.other
            parts = [(opening, False), (self.escape(role), False), (after, False), (self.escape(text), False), (closing, False)]
        return [p for p in parts if p[0] or p[1]]

    def step(self, state: str, role: str) -> str | None:
        """The state after a turn of the role, or None if it may not come now; the machine goes on from the role."""
        return role if role in self.template.follows.get(state, ()) else None

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of the turns in a formatted string."""
        t, out, at = self.template, [], 0
        while at < len(formatted):
            role = next((r for r, (o, _, _) in t.turns.items() if o and formatted.startswith(o, at)), None)
            if role is None and formatted.startswith(t.other[0], at):
                middle = formatted.index(t.other[1], at)
                role, closing, at = self.unescape(formatted[at + len(t.other[0]):middle]), t.other[2], middle + len(t.other[1])
            else:
                role = role if role is not None else next(r for r, (o, _, _) in t.turns.items() if not o)
                opening, closing, _ = t.turns[role]
                at += len(opening)
            end = formatted.index(closing, at)
            out.append((role, self.unescape(formatted[at:end])))
            at = end + len(closing)
        return out


SEGMENTS = "array<struct<text: string, loss: boolean>>"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(df: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, role, segments, problem`` for every row, conversations together and in turn order.

    Turns are ordered by ``turn``, nulls first, then role and text, so rows that repeat or tie have a fixed order. A null
    role is the role "", a null text is empty; both are formatted like any other. A null conversation id is one
    conversation. ``place`` counts from 0. ``problem`` says what the machine has against the turn: "unexpected <role>"
    if it may not follow the one before; on a conversation's last turn also "open end"; else null. Rows stream through:
    no conversation is held in memory, so one of any length can be formatted. Other columns aren't read.
    """
    ordered = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches):
        rules = Formatter(template)
        state, place, now, waiting = "start", 0, object(), None

        def closed(row, end):
            whole = not end or row[2] in template.ends
            return (*row[:4], "; ".join(filter(None, (row[4], None if whole else "open end"))) or None)

        def batch_of(rows, like):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], like), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                pa.array([[{"text": t, "loss": f} for t, f in s] for s in cols[3]], _SEGMENT), pa.array(cols[4], pa.string())], NAMES)

        like = None
        for batch in batches:
            like, out = batch.schema.types[0], []
            for conv, _, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None:
                    out.append(closed(waiting, conv != now))
                if waiting is None or conv != now:
                    state, place, now = "start", 0, conv
                problem = None if rules.step(state, r) else f"unexpected {r}"
                waiting = (conv, place, r, rules.segments(r, t), problem)
                state, place = r, place + 1
            if out:
                yield batch_of(out, like)
        if waiting is not None:
            yield batch_of([closed(waiting, True)], like)

    return ordered.mapInArrow(run, f"conv_id {kind}, place bigint, role string, segments {SEGMENTS}, problem string")


NAMES = ["conv_id", "place", "role", "segments", "problem"]


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of ``format_turns``' rows, in their order: what the formatted text and its mask hold.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_problems``. Roles and texts are parsed
    from the text alone, not taken from columns. The digests run over a conversation's turns one after the other, which
    is why its rows stay in one task; they pass through it as a stream.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        rules = Formatter(template)
        now, held, like = object(), None, None

        def rows_of(done):
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], like), pa.array(cols[1], pa.int64()), pa.array([h.hexdigest() for h in cols[2]]), pa.array(cols[3], pa.int64()),
                pa.array([h.hexdigest() for h in cols[4]]), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())], OUT)

        for batch in batches:
            like, done = batch.schema.types[0], []
            ids, segments, problems = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segments", "problem"))
            for conv, parts, problem in zip(ids, segments, problems):
                if held is None or conv != now:
                    if held is not None:
                        done.append(held)
                    now, held = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                whole = "".join(p["text"] for p in parts)
                for role, text in rules.read(whole):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                loss = rules.unescape("".join(p["text"] for p in parts if p["loss"]))
                held[3] += len(loss)
                held[4].update(loss.encode("utf-8", "replace"))
                held[5] += len(whole)
                held[6] += problem is not None
            if done:
                yield rows_of(done)
        if held is not None:
            yield rows_of([held])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_problems bigint")


OUT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_problems"]
