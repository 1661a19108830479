"""Chat formatting with a grammar round trip.

A conversation is rendered as turns of ``<turn>role<text>text</turn>`` and a line end. The grammar is deterministic:

    conversation = turn*
    turn         = "<turn>" chars "<text>" chars "</turn>" LF

Inside ``chars``, 2n+1 backslashes before a control string stand for n backslashes and the string itself, 2n before
the control string that the grammar expects for n backslashes and the end of the field; a control string that
is neither is an error. Backslashes before anything else stand for themselves.

A turn is first rendered with its role and text as they are and parsed again. Where what comes back differs
from the source, the first differing field is escaped and the turn is parsed again, until both are identical.
Turns end themselves, so a conversation is its turns one after another, rendered in parallel.

Defined results: null roles and texts are empty; rows without a ``conv_id`` are one conversation of null id; the rows
of a conversation go by turn (null first), equal turns by their rendered text; a table without rows gives no
rows; columns other than ``conv_id, turn, role, text`` are ignored. Texts of any length are rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import partitions, store

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
LINE = "\n"
#: Turns of this role are under the loss mask.
LEARNED = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, (TURN, TEXT, END))))
_SLASHES = re.compile(r"\\*\Z")


class Conflict(ValueError):
    """What was rendered cannot be parsed."""


def _slashes(s: str, start: int, end: int) -> int:
    """Backslashes of ``s[start:end]`` that stand directly before ``end``."""
    n = 0
    while end - n > start and s[end - n - 1] == "\\":
        n += 1
    return n


def escape(field: str) -> str:
    """``field`` as the grammar's ``chars``."""
    out, at = [], 0
    for m in _CONTROL.finditer(field):
        n = _slashes(field, at, m.start())
        out += [field[at : m.start()], "\\" * (n + 1), m.group()]
        at = m.end()
    tail = field[at:]
    return "".join([*out, tail, "\\" * _slashes(tail, 0, len(tail))])


def _chars(s: str, at: int, end: str) -> tuple[str, int] | None:
    """A field's own text from ``at`` and the place behind ``end``; None where ``s`` stops before it."""
    out, start = [], at
    while m := _CONTROL.search(s, at):
        n = _slashes(s, start, m.start())
        out += [s[start : m.start() - n], "\\" * (n // 2)]
        if n % 2 == 0:
            if m.group() != end:
                raise Conflict(f"{m.group()} at {m.start()} where {end} belongs")
            return "".join(out), m.end()
        out.append(m.group())
        start = at = m.end()
    return None


def parse(s: str) -> tuple[list[tuple[str, str]], str]:
    """The turns ``s`` holds, and what is left behind the last whole one."""
    turns, at = [], 0
    while at < len(s):
        if not s.startswith(TURN, at):
            if TURN.startswith(s[at:]):
                break
            raise Conflict(f"no turn at {at}")
        if (role := _chars(s, at + len(TURN), TEXT)) is None or (text := _chars(s, role[1], END)) is None:
            break
        if not s.startswith(LINE, text[1]):
            if text[1] == len(s):
                break
            raise Conflict(f"no line end at {text[1]}")
        turns.append((role[0], text[0]))
        at = text[1] + len(LINE)
    return turns, s[at:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses to exactly ``role`` and ``text``, and the start and end of its text."""
    fields, escaped = [role, text], [False, False]
    while True:
        head = TURN + fields[0] + TEXT
        out = head + fields[1] + END + LINE
        try:
            turns, rest = parse(out)
            got = turns[0] if len(turns) == 1 and not rest else None
        except Conflict:
            got = None
        if got == (role, text):
            return out, len(head), len(head) + len(fields[1])
        # the role is read first: while it may be what went wrong, it is the one to escape
        i = 1 if escaped[0] or (got is not None and got[0] == role) or escape(role) == role else 0
        if escaped[i]:
            raise Conflict("a turn differs though all of it is escaped")
        fields[i], escaped[i] = escape(fields[i]), True


FORMATTED = "conv_id long, turn long, formatted string, learned_from long, learned_to long"


def _render_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        made = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
        learned = [r == LEARNED for r in roles]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] if y else None for m, y in zip(made, learned, strict=True)], pa.int64()),
                pa.array([m[2] if y else None for m, y in zip(made, learned, strict=True)], pa.int64()),
            ],
            ["conv_id", "turn", "formatted", "learned_from", "learned_to"],
        )


def format_turns(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> each row rendered, with the span of code points under the loss mask
    (null for turns that are not learned)."""
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).mapInArrow(_render_batches, FORMATTED)


class _Reading:
    """What is read back of one conversation, piece by piece."""

    def __init__(self) -> None:
        self.rest, self.turns, self.learned, self.chars = "", 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def piece(self, formatted: str, start: int | None, end: int | None) -> None:
        self.chars += len(formatted)
        turns, self.rest = parse(self.rest + formatted)
        self.turns += len(turns)
        for role, text in turns:
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            # the masked span is a field of the grammar: read up to the control string behind it
            text, behind = _chars(formatted, start, END)
            if behind != end + len(END):
                raise Conflict("the loss mask does not end where the text does")
            self.learned += len(text)
            self.under.update(text.encode())

    def row(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise Conflict("a conversation stops inside a turn")
        return conv_id, self.turns, self.all.hexdigest(), self.learned, self.under.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []

    def out() -> pa.RecordBatch:
        names = [c.split()[0] for c in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*done, strict=True)) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for conv_id, _, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv_id != now:
                if state is not None:
                    done.append(state.row(now))
                now, state = conv_id, _Reading()
            state.piece(formatted, start, end)
        if len(done) >= 10_000:
            yield out()
            done = []
    if state is not None:
        done.append(state.row(now))
    yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted turns hold, by conversation, parsed from their text alone.

    A conversation's turns reach one task in order, since its digests run over them in order; the task keeps
    the running digests and an unfinished turn, however long the conversation is.
    """
    return (
        formatted.repartition(partitions(formatted.sparkSession), "conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")
        .mapInArrow(_read_batches, READ)
    )


def round_trip(rows: DataFrame) -> DataFrame:
    """Formats ``rows``, writes the result to the shared folder and reads the written turns back."""
    return read_back(store(format_turns(rows), "formatted"))
