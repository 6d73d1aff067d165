"""Chat formatting whose text is read back by a parser: content that would read differently is escaped."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back

#: A turn is OPEN role SEP text CLOSE. ESCAPE before one of its own or a mark's first character makes that plain text.
OPEN, SEP, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
ROLE = "assistant"
_ESCAPED = re.compile(r"\\([\\#:<])")
_SPECIAL = re.compile(r"[\\#<]")
_SPECIAL_ROLE = re.compile(r"[\\#:<]")
_TOKEN = re.compile(r"\\[\\#:<]|### | </turn>\n")
_ROLE_TOKEN = re.compile(r"\\[\\#:<]|### | </turn>\n|: ")


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped; ValueError where it doesn't follow the grammar."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(OPEN)
        role, at = _until(text, at, _ROLE_TOKEN, SEP)
        body, at = _until(text, at, _TOKEN, CLOSE)
        out.append((role, body))
    return out


def _until(text: str, at: int, tokens: re.Pattern, end: str) -> tuple[str, int]:
    """What stands before the first mark that isn't escaped, which must be `end`."""
    first = at
    for m in tokens.finditer(text, at):
        if m[0][0] != ESCAPE:
            if m[0] != end:
                raise ValueError(f"{m[0]!r} at {m.start()}")
            return _ESCAPED.sub(r"\1", text[first : m.start()]), m.end()
    raise ValueError(f"no {end!r} after {first}")


def render_turn(role: str, text: str) -> str:
    """One formatted turn that parses back to exactly (role, text): as it is if that does, else escaped further."""
    every = lambda x, special: special.sub(lambda m: ESCAPE + m[0], x)
    for as_role, as_text in ((role, text), (role, every(text, _SPECIAL)), (every(role, _SPECIAL_ROLE), every(text, _SPECIAL))):
        out = f"{OPEN}{as_role}{SEP}{as_text}{CLOSE}"
        try:
            if parse_turns(out) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn can't be escaped")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted): every row with its part of the conversation's formatted text.

    Null roles and texts are empty. A conversation's whole text is its parts in the order of turn, role and text; each
    part parses to one turn by itself, and so they do together.
    """
    bounded_batches(conversations.sparkSession)

    @giving_back
    def run(batches):
        for b in batches:
            made = [render_turn(r, x) for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["conv_id", "turn", "role", "text", "formatted"])

    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string")


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        for role, text in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == ROLE:
                self.loss += len(text)
                self.masked.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_turns() alone.

    The rows of a conversation come to one task in order and are read one after the other; nothing of it is held but the
    running digests, so a conversation may have any number of turns. A null conv_id is one conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))

    @giving_back
    def run(batches):
        now, at = None, None
        for b in batches:
            done = []
            for conv, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now is None or conv != at:
                    done += [(at, *now.row())] if now else []
                    now, at = _Digest(), conv
                now.add(part)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (at, *now.row())))], schema=schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
