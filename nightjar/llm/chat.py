"""Chat formatting (operator 2): budgeted windows over conversations.

A conversation is cut into windows of at most ``BUDGET`` tokens. Running sums of the turns'
tokens choose spans of whole turns: a window takes turns while the sum since its start stays
within the budget that the retained system turn and the repeated history leave. Every window
begins with the system turn; from the second on, the last turns before it are repeated, up
to ``HISTORY`` tokens, as context. The loss mask covers each assistant text once: where it
is new, never where it is repeated.

The template writes a turn as ``### role: text </turn>\\n``. Inside role and text a backslash
is doubled and put into every ``###`` and ``</turn>`` (in a role also before a colon), so
that a text can't open or close a turn; ``unescape`` gives the text back.

Conversations are hashed to partitions and sorted there by turn; a task reads its rows as a
stream and holds one window and its history, so a conversation of any length takes bounded
memory. A single turn over the budget makes a window of its own, whole.

Defined results: null text or role counts as empty; equal turn numbers are ordered by role
and text, null ones come first; rows with a null id are one conversation; repeated rows are
turns of their own; an empty table gives no window. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUDGET = 2048       # tokens of a window
HISTORY = 256       # tokens of repeated turns in it
SYSTEM, TARGET = "system", "assistant"
END = " </turn>\n"

#: Of a window: its formatted text; by turn the first code point and the end of the escaped
#: text; whether the turn is new (not retained or repeated); whether the loss covers it.
WINDOWS = ("conv_id long, window int, formatted string, n_tokens long, starts array<int>, ends array<int>, "
           "fresh array<boolean>, loss array<boolean>")


def escape(text: str) -> str:
    return re.sub(r"#(?=##)", r"#\\", text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))


_ESCAPED = re.compile(r"\\\\|<\\/turn>|#\\(?=#)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\\\": "\\", "<\\/turn>": "</turn>"}.get(m[0], "#"), text)


def head(role: str) -> str:
    return f"### {escape(role).replace(':', chr(92) + ':')}: "


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, back from its formatted text alone."""
    turns = []
    for part in formatted.split(END)[:-1]:
        m = re.match(r"### ((?:[^\\:]|\\.)*): ", part, re.S)
        turns.append((unescape(m[1].replace("\\:", ":")), unescape(part[m.end():])))
    return turns


class Windows:
    """Cuts the turns of one conversation, given in order, into windows."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.limit = conv_id, budget, history
        self.system, self.history, self.fresh = None, deque(), []
        self.total = self.start = self.kept = 0     # running sum; its value at the window's start; history's
        self.number, self.first = 0, True

    def add(self, role: str, text: str, tokens: int):
        """Takes the next turn; gives the window that it closes, if any."""
        out = None
        if self.first and role == SYSTEM:
            self.system = (role, text, tokens)
        else:
            room = self.budget - (self.system[2] if self.system else 0)
            if self.fresh and self.total + tokens - self.start > room - self.kept:
                out = self.close()
            while not self.fresh and self.history and tokens > room - self.kept:
                self.kept -= self.history.popleft()[2]      # a long turn goes before its history
            self.fresh.append((role, text, tokens))
            self.total += tokens
        self.first = False
        return out

    def close(self):
        """The open window; what follows repeats its last turns."""
        out = self.emit()
        for turn in self.fresh:
            self.history.append(turn)
            self.kept += turn[2]
            while self.kept > self.limit:
                self.kept -= self.history.popleft()[2]
        self.fresh, self.start, self.number = [], self.total, self.number + 1
        return out

    def emit(self):
        text, at, starts, ends, fresh, loss, tokens = [], 0, [], [], [], [], 0
        turns = [(self.system, self.number == 0)] if self.system else []
        turns += [(t, False) for t in self.history] + [(t, True) for t in self.fresh]
        for (role, body, n), new in turns:
            opening, body = head(role), escape(body)
            starts.append(at + len(opening))
            ends.append(starts[-1] + len(body))
            at = ends[-1] + len(END)
            text += [opening, body, END]
            fresh.append(new)
            loss.append(new and role == TARGET)
            tokens += n
        return self.conv_id, self.number, "".join(text), tokens, starts, ends, fresh, loss


def _turns(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows, names, types, at_once=256):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield _batch(held, names, types)
            held = []
    yield _batch(held, names, types)


def _batch(rows, names, types):
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def format_windows(turns: DataFrame, path: str | None = None, budget: int = BUDGET,
                   history: int = HISTORY) -> DataFrame:
    """The windows (``WINDOWS``) of all conversations ``(conv_id, turn, role, text)``. Tokens
    are those of the vocabulary at ``path`` over the turn as the template writes it."""
    path = path or common.vocabulary("byte_bpe_50k.json")
    ordered = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                           common.text_of().alias("text")) \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [f.split()[0] for f in WINDOWS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.bool_())] * 2]

    def run(batches):
        count = common.token_counter(path)

        def rows():
            now = None
            for conv_id, _, role, text in _turns(batches):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.emit()
                    now = Windows(conv_id, budget, history)
                if done := now.add(role, text, count(head(role) + escape(text) + END)):
                    yield done
            if now is not None:
                yield now.emit()

        yield from _batches(rows(), names, types)

    return ordered.mapInArrow(run, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss mask and length."""
    ordered = windows.select("conv_id", "window", "formatted", "starts", "ends", "fresh", "loss") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, " \
             "formatted_chars long, n_windows long"

    def run(batches):
        def rows():
            now, state = (), None
            for conv_id, _, formatted, starts, ends, fresh, loss in _turns(batches):
                if (conv_id,) != now:
                    if state:
                        yield _digest(now[0], state)
                    now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for (role, text), new in zip(parse(formatted), fresh):
                    if new:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for a, b, counts in zip(starts, ends, loss):
                    if counts:
                        text = unescape(formatted[a:b])
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += 1
            if state:
                yield _digest(now[0], state)

        yield from _batches(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                     "formatted_chars", "n_windows"],
                            [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return ordered.mapInArrow(run, schema)


def _digest(conv_id, s):
    return conv_id, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]


def op2_chat(spark, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                  "conv_id long, turn long, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(common.materialise(format_windows(turns), "windows"))
