"""Chat formatting with spans found by rendering growing prefixes of a conversation.

The template is a black box: a function from a list of turns to text. Rendering
the turns up to each one and comparing consecutive outputs shows what a turn
adds; where an output does not begin with the one before, the template rewrites
history. Rendering a turn with two different probe texts in its place shows what
the template puts before and after the text, hence the text's own span.

Every prefix is rendered whole, so a conversation takes time in the square of its
length. A template may claim to write each turn without regard to the others; then
a prefix is the one before and the turn alone, and the claim is checked at each
turn against the rendering of a window of turns before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duolith.llm.common import bounded

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns before each one with which a template's claim is checked.
CHECKED_TURNS = 8


def escaped(text: str) -> str:
    """Control marks begin with < or [; a backslash before these, and before itself, makes them text."""
    return re.sub(r"[\\<\[]", r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\<\[])", r"\1", text)


def instruction_template(turns: list[Turn]) -> str:
    """Marks each turn with its role and closes assistant turns: <s>[role] text [/role]</s>."""
    return "".join(f"<s>[{escaped(role)}] {escaped(text)} [/{escaped(role)}]</s>\n" for role, text in turns)


#: A turn as instruction_template writes it.
WRITTEN = re.compile(r"<s>\[((?:\\.|[^\\\[<])*?)\] ((?:\\.|[^\\\[<])*) \[/\1\]</s>\n", re.DOTALL)


def read_turns(formatted: str) -> list[Turn]:
    """Reads the turns back from what instruction_template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = WRITTEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def common_prefix(a: str, b: str, start: int = 0) -> int:
    """Length of the common prefix, from a place up to which they are known to agree."""
    if a.startswith(b[start:], start):
        return len(b)
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def frame(render: Template, before: list[Turn], role: str, after: list[Turn] = ()) -> tuple[int, int]:
    """Characters that the template puts before and after a turn's text, counted from the output's ends."""
    one, two = (render([*before, (role, probe), *after]) for probe in ("0", "1"))
    head = common_prefix(one, two)
    return head, common_prefix(one[::-1], two[::-1])


class ChatFormat(NamedTuple):
    """A template with what reads its output back: turns, and the plain text of a span."""

    render: Template
    read: Callable[[str], list[Turn]]
    plain: Callable[[str], str]
    alone: bool = False  # the claim that it writes each turn without regard to the others


INSTRUCTIONS = ChatFormat(instruction_template, read_turns, unescaped, alone=True)


class Span(NamedTuple):
    added: str  # what the turn adds to the output
    start: int  # its text within that
    end: int
    rewrites: bool  # the output does not begin with the one before


class Prefixes:
    """Renders one prefix more with each turn; a template that claims to write turns alone keeps CHECKED_TURNS of them."""

    def __init__(self, form: ChatFormat):
        self.render, self.alone, self.seen = form.render, form.alone, []
        self.opening = self.before = self.render([])

    def add(self, role: str, text: str) -> Span:
        out = self.render([*self.seen, (role, text)])
        head, tail = frame(self.render, self.seen, role)
        rewrites = not out.startswith(self.before)
        at = 0 if rewrites else len(self.before)
        if self.alone and (rewrites or self.opening + out[at:] != self.render([(role, text)])):
            raise ValueError("the template claims to write each turn alone and does not")
        self.seen.append((role, text))
        self.before = out
        if self.alone and len(self.seen) > 2 * CHECKED_TURNS:
            self.seen = self.seen[-CHECKED_TURNS:]
            self.before = self.render(self.seen)
        return Span(out[at:], head - at, len(out) - tail - at, rewrites)


def format_conversation(turns: list[Turn], render: Template | ChatFormat = INSTRUCTIONS, learn: str = "assistant") -> dict:
    """Formatted text and loss spans (start, end) of the turns whose role is `learn`.

    Where the template rewrites history the output is rendered once as a whole, and
    each span is found in it by probes.
    """
    form = render if isinstance(render, ChatFormat) else ChatFormat(render, read_turns, unescaped)
    prefixes = Prefixes(form)
    spans, parts, at = [], [prefixes.before], len(prefixes.before)
    for role, text in turns:
        s = prefixes.add(role, text)
        if s.rewrites:
            out = form.render(turns)
            spans = [(f[0], len(out) - f[1]) for i, (r, _) in enumerate(turns) if r == learn for f in [frame(form.render, turns[:i], r, turns[i + 1 :])]]
            return {"formatted": out, "loss": spans, "rewrites_history": True}
        if role == learn:
            spans.append((at + s.start, at + s.end))
        parts.append(s.added)
        at += len(s.added)
    return {"formatted": "".join(parts), "loss": spans, "rewrites_history": False}


SCHEMA = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"


def coded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Digest:
    """Sums of one conversation, read back from its output; turns come one by one.

    Of a template that writes turns alone only the sums are held; of any other the
    whole conversation, as its output may change with each turn.
    """

    def __init__(self, form: ChatFormat) -> None:
        self.form, self.prefixes, self.told = form, Prefixes(form) if form.alone else None, []
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.chars = len(self.prefixes.opening) if form.alone else 0

    def add(self, role: str, text: str) -> None:
        if self.prefixes is None:
            self.told.append((role, text))
            return
        s = self.prefixes.add(role, text)
        self.take(s.added, [(s.start, s.end)] * (role == "assistant"))

    def take(self, out: str, loss: list[tuple[int, int]]) -> None:
        for r, t in self.form.read(out):
            self.turns.update(coded(f"{r}\n{t}\n"))
            self.n += 1
        for a, b in loss:
            learned = self.form.plain(out[a:b])
            self.loss.update(coded(learned))
            self.loss_chars += len(learned)
        self.chars += len(out)

    def row(self) -> tuple:
        rewrites = False
        if self.prefixes is None:
            made = format_conversation(self.told, self.form)
            self.take(made["formatted"], made["loss"])
            rewrites = made["rewrites_history"]
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, rewrites


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, by turn; ties go by role and text, nulls first."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digest_conversations(conversations: DataFrame, form: ChatFormat = INSTRUCTIONS) -> DataFrame:
    """Formats every conversation and reads it back from the output.

    Takes conv_id, turn, role, text; returns a row for each conv_id (null is one
    too): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    rewrites_history. A conversation's rows stream through one task in order, as a
    digest needs; of a form that writes turns alone the step holds a few turns, of any
    other the conversation. Turns go by turn, then role, then text, nulls first. Null
    role and text count as empty, repeated rows are turns of their own, an empty table
    gives an empty table, and other columns are not read.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    schema = f"conv_id {kind}, {SCHEMA}"
    want = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(want)
        put = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
        key, held, done = None, None, []
        for batch in batches:
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held is None or k != key:
                    if held:
                        done.append((key, *held.row()))
                    key, held = k, Digest(form)
                held.add(role, text)
            if len(done) >= 1000:
                yield put(done)
                done = []
        if held:
            done.append((key, *held.row()))
        if done:
            yield put(done)

    return bounded(ordered(conversations)).mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, form: ChatFormat = INSTRUCTIONS) -> DataFrame:
    """The formatted turns themselves: conv_id, turn, formatted, loss_start, loss_end (null where not learned).

    Offsets count from the turn's own formatted text; the conversation is its turns'
    formatted texts joined in order. A form that rewrites history has no such turns:
    formatted is then null from the turn on that does so (format_conversation gives
    the whole). Rows and nulls as in digest_conversations.
    """
    kinds = dict(conversations.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start bigint, loss_end bigint"
    want = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(want)
        key, prefixes, broken = None, None, False
        for batch in batches:
            rows = []
            for k, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prefixes is None or k != key:
                    key, prefixes, broken = k, Prefixes(form), False
                s = prefixes.add(role, text)
                broken |= s.rewrites
                rows.append((k, turn, None if broken else s.added, *((s.start, s.end) if role == "assistant" and not broken else (None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return bounded(ordered(conversations)).mapInArrow(run, schema)
