"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows. The prefix sums of its turns' tokens
choose turn-aligned spans: a window takes new turns as long as system turn, repeated
history and new turns together hold at most ``span`` tokens, and is cut before the turn
that does not fit. Every window starts with the conversation's system turn and repeats, of
the turns before its own, the latest that hold at most ``history`` tokens and leave room
for its first new turn; whole turns only. The loss mask covers the texts of assistant
turns where they are new; repeated ones are masked out, so each target counts once. Turns
are never cut: only a turn that does not fit into the span beside the system turn makes a
window of more tokens, in which it is the only new turn and nothing but the system turn is
repeated (``n_tokens`` shows it).

Template: ``### role:``, a line break, the text, ``</turn>``, a line break. Inside a text a
backslash is doubled and the control strings ``###`` and ``</turn>`` get a backslash before
them; a role has its backslashes, colons and line breaks marked the same way. ``parse``
reads a window back.

Rows are dealt by conversation and sorted by turn; a task streams over them and holds one
window of one conversation, however long the conversation is. Texts are read back by
searching for the next end mark, in memory of their own size.

Defined results: null texts and roles count as empty; a null conv_id is a conversation of
its own; rows of the same conversation and turn are turns of their own, in the order of
role and text; a system turn after the first is a turn like any other; an empty input gives
no windows; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, HISTORY = 1024, 256
TURN_END = "</turn>"
_ROLE_CONTROL = re.compile(r"[\\:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\w+|[^\w\s]")

WINDOW_SCHEMA = "conv_id long, window long, first_turn long, n_repeated long, n_new long, n_tokens long, formatted string, loss array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
_FLUSH = 256


def n_tokens(text: str) -> int:
    """Tokens of a turn for the budget: words, single marks, and the turn's end; any count that adds up over turns would do."""
    return 1 + sum(1 for _ in _TOKEN.finditer(text))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(TURN_END, "\\" + TURN_END)


def escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], n_repeated: int) -> tuple[str, list[dict]]:
    """The formatted window and the spans, in code points, of its new assistant texts."""
    parts, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"### {escape_role(role)}:\n", escape(text)
        parts += [head, body, TURN_END + "\n"]
        if role == "assistant" and i >= n_repeated:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join(parts), loss


def _unescaped(text: str, mark: str, start: int) -> int:
    """Where ``mark`` next stands with an even number of backslashes before it, or -1."""
    at = text.find(mark, start)
    while at >= 0:
        k = at
        while k > start and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at = text.find(mark, at + 1)
    return -1


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        colon = _unescaped(formatted, ":\n", at + 4) if formatted.startswith("### ", at) else -1
        end = _unescaped(formatted, TURN_END + "\n", colon + 2) if colon >= 0 else -1
        if end < 0:
            raise ValueError(f"no turn starts at {at}")
        out.append((unescape(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : end])))
        at = end + len(TURN_END) + 1
    return out


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv: int | None, span: int, history: int):
        self.conv, self.span, self.history = conv, span, history
        self.turn = self.no = self.first = self.sum = 0  # ``sum``: tokens of all turns so far
        self.system: tuple[str, str] | None = None
        self.system_at, self.system_tokens = -1, 0
        self.new: list[tuple[str, str]] = []
        self.past: deque[tuple[int, tuple[str, str], int]] = deque()  # (place, turn, sum before it): the latest that fit the history
        self.begin = self.before = 0  # sum before the first new turn; tokens repeated in front of it

    def add(self, role: str, text: str) -> list[tuple]:
        out, n = [], n_tokens(text)
        if self.new and self.before + self.sum + n - self.begin > self.span:
            out.append(self.close())
        if not self.new:
            self._open(n)
        self.new.append((role, text))
        self.past.append((self.turn, (role, text), self.sum))
        self.sum += n
        if role == "system" and self.system is None:
            self.system, self.system_at, self.system_tokens = (role, text), self.turn, n
        self.turn += 1
        while self.past and self.sum - self.past[0][2] > self.history:
            self.past.popleft()
        return out

    def _open(self, n: int) -> None:
        """Choose what is repeated before a first new turn of n tokens."""
        system = self.system_tokens if self.system is not None else 0
        least = self.sum - min(self.history, max(0, self.span - n - system))
        self.shown = [t for place, t, before in self.past if before >= least and place != self.system_at]
        kept = [(place, before) for place, _, before in self.past if before >= least]
        self.before = system + (self.sum - kept[0][1] if kept else 0)
        if self.system is not None:
            self.shown.insert(0, self.system)
            if any(place == self.system_at for place, _ in kept):
                self.before -= system
        self.first, self.begin = self.turn, self.sum

    def close(self) -> tuple:
        turns = self.shown + self.new
        text, loss = render(turns, len(self.shown))
        row = (self.conv, self.no, self.first, len(self.shown), len(self.new), self.before + self.sum - self.begin, text, loss)
        self.new, self.no = [], self.no + 1
        return row


def _formatter(span: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Windows | None = None
        rows: list[tuple] = []
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None and now.new:
                        rows.append(now.close())
                    now = _Windows(conv, span, history)
                rows += now.add(role, text)
                if len(rows) >= _FLUSH:
                    yield _table(rows, _WINDOW)
                    rows = []
        if now is not None and now.new:
            rows.append(now.close())
        if rows:
            yield _table(rows, _WINDOW)

    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window: its text, how many of its turns are repeated, and the spans under the loss mask.

    The windows of a conversation are in one partition, in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(span, history), WINDOW_SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its windows alone, which come in order."""
    state: list | None = None
    done: list[tuple] = []
    start = object()
    conv_now: object = start

    def close() -> tuple:
        n, turns, chars, loss, size, windows = state
        return (conv_now, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows)

    for b in batches:
        for conv, n_repeated, formatted, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "loss")), strict=True):
            if conv_now is start or conv != conv_now:
                if state is not None:
                    done.append(close())
                conv_now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(formatted)[n_repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for s in loss:
                text = unescape(formatted[s["start"] : s["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += 1
            if len(done) >= _FLUSH:
                yield _table(done, _DIGEST)
                done = []
    if state is not None:
        done.append(close())
    if done:
        yield _table(done, _DIGEST)


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the windows as ``format_conversations`` returns them."""
    return windows.mapInArrow(_read_back, DIGEST_SCHEMA)
