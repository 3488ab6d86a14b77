"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The turns of a
conversation are rendered as successive prefixes; each output must extend the one before, and what
it adds is the turn's span. A template that rewrites its history is detected by that comparison and
refused. Within a span, the text under the loss mask is located the same way: by rendering the turn
with probe texts and comparing.

Rendering all prefixes of n turns costs n * n. A template that declares with `local = True` that its
output for a turn depends on the first and the previous turn at most, and that it never rewrites what
came before, is rendered in windows of `WINDOW` turns that begin with the first turn and the last turn
before the window, so cost and memory stay linear. Any other template is rendered over whole prefixes,
whatever the length: its conversations are held whole.

Conversations are gathered by hash of conv_id and sorted by turn; a task streams over its rows and
with a local template holds one window, never a whole conversation. One conversation's hash digest is sequential, so its
rows must meet in one task; they pass through it in bounded memory.

Defined cases: null role or text is empty; equal turns go by role and text; null conv_id is one
conversation; an empty table gives the added conversation alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpress.llm.shared import bounded_batches

WINDOW = 32
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
START, STOP, ESCAPE = "<|im_start|>", "<|im_end|>", "\\"
_TOKEN = re.compile(r"<(\\*)\|im_(start|end)\|>")
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|im_(?:start|end)\|>)[\s\S])*?)\n([\s\S]*?)<\|im_end\|>\n")


class RewritesHistory(ValueError):
    """A template changed what it had rendered for earlier turns."""


def escape(text: str) -> str:
    """One more backslash after the < of each control string, escaped ones included: reversible for every text."""
    return _TOKEN.sub(lambda m: f"<{m[1]}{ESCAPE}|im_{m[2]}|>", text)


def unescape(text: str) -> str:
    return _TOKEN.sub(lambda m: f"<{m[1][:-1]}|im_{m[2]}|>", text)


def escape_role(role: str) -> str:
    return escape(role).replace(ESCAPE, ESCAPE * 2).replace("\n", ESCAPE + "n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else ESCAPE, role))


def chatml(turns: list[Turn]) -> str:
    """The production template: marked turns, control strings inside texts escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{STOP}\n" for role, text in turns)


chatml.local = True

def spans(template: Template, turns: list[Turn], context: list[Turn] = [], trained: str = "assistant") -> list[tuple[str, int, int]]:  # noqa: B006
    """What each turn adds to the rendering of its prefix, and from where to where its text lies in that (0, 0 if not trained on).

    A text is located by rendering its turn with two probe texts in its place: where their outputs
    first and last differ, the text begins and ends.
    """
    before, out = template(context), []
    for i, (role, _) in enumerate(turns):
        now = template(context + turns[: i + 1])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {i}: the rendering of {len(context) + i} turns is no prefix of that of one more")
        span, a, b = now[len(before) :], 0, 0
        if role == trained:
            x, y = (template(context + turns[:i] + [(role, probe)])[len(before) :] for probe in "ab")
            a = next(k for k in range(len(x)) if x[k] != y[k])
            b = len(span) - (len(x) - a - 1)
        out.append((span, a, b))
        before = now
    return out


def rendered(template: Template, turns: Iterable[Turn]) -> Iterator[tuple[str, int, int]]:
    """The spans of a conversation of any length, in windows if the template is local."""
    if not getattr(template, "local", False):
        yield from spans(template, list(turns))
        return
    first: list[Turn] = []
    last: list[Turn] = []
    window: list[Turn] = []
    for turn in turns:
        window.append(turn)
        if len(window) == WINDOW:
            yield from spans(template, window, first + last)
            first, last, window = first or window[:1], window[-1:], []
    if window:
        yield from spans(template, window, first + last)


def parse(formatted: str) -> list[Turn]:
    """The turns of a rendering of `chatml`, read back from it alone."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digest(template: Template, turns: Iterable[Turn]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered spans."""
    n = chars = formatted = 0
    every, loss = hashlib.sha256(), hashlib.sha256()
    for span, a, b in rendered(template, turns):
        formatted += len(span)
        back = parse(span)
        if len(back) != 1:
            raise ValueError("a turn's span does not read back as one turn")
        ((role, text),) = back
        n += 1
        every.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        masked = unescape(span[a:b])
        loss.update(masked.encode("utf-8", "replace"))
        chars += len(masked)
    return n, every.hexdigest(), chars, loss.hexdigest(), formatted


def format_chats(conversations: DataFrame, template: Template = chatml) -> DataFrame:
    """One row per conversation; the rendering stays in the task that made it."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c)
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), text("role"), text("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        ahead = next(flow, None)
        done: list[tuple] = []
        while ahead is not None:
            conv = ahead[0]

            def own(conv: int = conv) -> Iterator[Turn]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    now, ahead = ahead, next(flow, None)
                    yield now[1:]

            done.append((conv, *digest(template, own())))
            if len(done) >= 1000 or ahead is None:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])
                done = []

    return ordered.mapInArrow(run, SCHEMA)


TYPES = [pa.int64() if f.endswith("long") else pa.string() for f in SCHEMA.split(", ")]


def with_added(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table with conversation -1, whose texts are made of control strings."""
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversations.select([conversations[f.name].cast(f.dataType) for f in extra.schema]).unionByName(extra)
