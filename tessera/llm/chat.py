"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens. Prefix
sums of the turns' tokens choose spans of whole turns: every window opens with
the system turn (a first turn of role "system", repeated in each window), then
repeats as much of the latest history as fits ``history`` tokens, then takes new
turns as long as the budget lasts, one at least. So a turn that alone exceeds
the budget stands in an oversize window of its own; nothing is cut. What is
counted is the turn as it is written, with its marks and escapes; as every turn
ends its line, no token spans two turns, and a window's tokens are the sum of its
turns'. Assistant turns are targets: their text is under the loss mask where the
turn is new, and masked where it is repeated.

Template: ``<|turn|>role\\n text <|end|>\\n`` per turn. Control strings inside roles and
texts get a backslash after their first character, and one more where backslashes
stand there already, so that unescaping gives back every text.

Turns are counted where they are read, whatever conversation they belong to. Then
each conversation streams through one task in turn order, one window in memory at
a time, so that a conversation of any number of turns needs only the memory of a
window.

Defined cases: null texts and null roles count as empty; texts of any length are
whole turns; turns are ordered by turn (null first), then role, then text, so
ties and repeated rows have one order and all stay; a null conv_id is one
conversation; only a first turn can be the system turn; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import portions

BUDGET, HISTORY = 1024, 256
TURN, END = "<|turn|>", "<|end|>"
#: Strings that steer a model in this or another common template: fixed values.
CONTROLS = (
    TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))
_FIRST = "".join(dict.fromkeys(c[0] for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))

WINDOWS = "conv_id long, nth int, text string, targets array<struct<start:int,stop:int>>, n_new int, n_turns int, n_tokens long"


def _put(pattern: re.Pattern, text: str, slash: str) -> str:
    if not any(c in text for c in _FIRST):
        return text
    return pattern.sub(lambda m: "".join((g := [x for x in m.groups() if x is not None])[:1] + [slash] + g[1:]), text)


def escape(text: str) -> str:
    return _put(_ESCAPE, text, "\\")


def unescape(text: str) -> str:
    return _put(_ESCAPED, text, "")


def _role(role: str) -> str:
    """A role on one line: backslash and line end are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@dataclass
class Turn:
    """A turn as it is written: its head, its escaped text, and the tokens of all of it."""

    role: str
    head: str
    body: str
    tokens: int

    @property
    def target(self) -> bool:
        return self.role == "assistant"


@dataclass
class Window:
    text: str
    targets: list[tuple[int, int]]
    n_new: int
    n_turns: int
    n_tokens: int


def turn(role: str, text: str, tokens: int = 0) -> Turn:
    return Turn(role, f"{TURN}{_role(role)}\n", escape(text), tokens)


def said(role: str, text: str) -> str:
    """A turn as it is written."""
    t = turn(role, text)
    return f"{t.head}{t.body}{END}\n"


def _window(system: list[Turn], past: list[Turn], new: list[Turn]) -> Window:
    parts, targets, at = [], [], 0
    for k, t in enumerate(turns := [*system, *past, *new]):
        start = at + len(t.head)
        if t.target and k >= len(turns) - len(new):
            targets.append((start, start + len(t.body)))
        parts += [t.head, t.body, END, "\n"]
        at = start + len(t.body) + len(END) + 1
    return Window("".join(parts), targets, len(new), len(turns), sum(t.tokens for t in turns))


def windows(turns: Iterable[Turn], budget: int = BUDGET, history: int = HISTORY) -> Iterator[Window]:
    """The windows of one conversation.

    ``sums[k]`` are the tokens before turn k of those still held, and sums[-1]
    of all: a window is a span [low, fresh) of history and [fresh, end) of new
    turns, chosen by differences of these sums. What no later window can repeat
    is let go.
    """
    system: list[Turn] = []
    held: list[Turn] = []
    sums, low, fresh, fixed = [0], 0, 0, 0
    for k, t in enumerate(turns):
        if k == 0 and t.role == "system":
            system, fixed = [t], t.tokens
            continue
        if fresh < len(held) and fixed + sums[-1] - sums[low] + t.tokens > budget:
            yield _window(system, held[low:fresh], held[fresh:])
            fresh = len(held)
            room = min(history, budget - fixed - t.tokens)
            low = min(bisect_left(sums, sums[-1] - room), fresh)
            held, sums, low, fresh = held[low:], sums[low:], 0, fresh - low
        held.append(t)
        sums.append(sums[-1] + t.tokens)
    if system or fresh < len(held):
        yield _window(system, held[low:fresh], held[fresh:])


COUNTED = "conv_id long, turn long, role string, text string, tokens long"


def _counted(conversations: DataFrame, file: str) -> DataFrame:
    """Turns with their tokens as they are written: conversations do not matter yet, so a long one is spread like any other rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(file)
        try:
            for whole in batches:
                for b in portions(whole, 3, bpe.PORTION_ROWS, bpe.PORTION_BYTES):
                    texts = pa.array([said(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.string())
                    n = encoder.count_all(texts)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [c.split()[0] for c in COUNTED.split(", ")])
        finally:
            encoder.forget()

    return plain.mapInArrow(run, COUNTED)


def _sorted(counted: DataFrame) -> DataFrame:
    order = ("conv_id", "turn", "role", "text")
    return counted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "tokens")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
    for b in batches:
        for i in range(b.num_rows):
            conv, role, text, tokens = (b.column(j)[i].as_py() for j in range(4))
            yield conv, turn(role, text, tokens)


def _by_conversation(turns: Iterator[tuple[int | None, Turn]]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """One pass, nothing held."""
    for conv, group in groupby(turns, key=lambda x: x[0]):
        yield conv, (t for _, t in group)


def _format(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[tuple[int | None, int, Window]]:
    for conv, turns in _by_conversation(_turns(batches)):
        for nth, w in enumerate(windows(turns, budget, history)):
            yield conv, nth, w


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """One row per window: conv_id, nth, text, targets (spans of text under the loss), n_new, n_turns, n_tokens."""
    file = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            conv, nth, text, targets, new, n, tokens = zip(*rows)
            arrays = [
                pa.array(conv, pa.int64()), pa.array(nth, pa.int32()), pa.array(text, pa.string()),
                pa.array([[{"start": x, "stop": y} for x, y in t] for t in targets], spans),
                pa.array(new, pa.int32()), pa.array(n, pa.int32()), pa.array(tokens, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "nth", "text", "targets", "n_new", "n_turns", "n_tokens"])

        size = 0
        for conv, nth, w in _format(batches, budget, history):
            rows.append((conv, nth, w.text, w.targets, w.n_new, w.n_turns, w.n_tokens))
            size += len(w.text)
            if len(rows) >= 1000 or size > 4_000_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return _sorted(_counted(conversations, file)).mapInArrow(run, WINDOWS)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of the turns of a formatted window; start and stop are of the escaped text."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(END, line + 1)
        out.append((_unrole(text[at + len(TURN) : line]), unescape(text[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return out


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns and the text under the loss mask, digested in order.

    Windows arrive sorted by conversation and number; repeated turns are left out,
    the system turn is counted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        none = object()
        conv, n, said, loss, chars, size = none, 0, None, None, 0, 0

        def close() -> None:
            if conv is not none:
                rows.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for i in range(b.num_rows):
                own, nth, text, targets, new = (b.column(j)[i].as_py() for j in range(5))
                if conv is none or own != conv:
                    close()
                    conv, n, said, loss, chars, size = own, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                turns = parse(text)
                for k, (role, body, _, _) in enumerate(turns):
                    if k >= len(turns) - new or nth == 0:
                        n += 1
                        said.update(f"{role}\n{body}\n".encode())
                for t in targets:
                    body = unescape(text[t["start"] : t["stop"]])
                    loss.update(body.encode())
                    chars += len(body)
                size += len(text)
            if rows:
                yield _out(rows)
                rows = []
        close()
        if rows:
            yield _out(rows)

    def _out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in READ_BACK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return formatted.mapInArrow(run, READ_BACK)


def report(conversations: DataFrame) -> DataFrame:
    """READ_BACK of every conversation. Windows leave format_windows whole and in order, so reading them back takes no shuffle."""
    return read_back(format_windows(conversations))
