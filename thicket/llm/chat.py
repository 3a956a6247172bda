"""Chat formatting in budgeted windows.

A conversation's turns become windows of text. Prefix sums of turn tokens (of each
turn by itself as it is written, with marks and escapes) choose
each window's span of new turns, cut between turns only. Before them a window
repeats the system turn and, within ``history_tokens``, the turns just before.
Loss falls on the texts of new assistant turns alone, so every assistant text
is a target once, however often it is repeated as history. A turn that does not
fit by itself has a window of its own, over the budget and marked so.

A turn is written as ``<|role|>text</s>``. Control strings inside a text get a
backslash after their first character (one more than follows it already), which
leaves no control string and can be undone exactly. Roles are percent-encoded.

Rows are dealt by conversation and sorted in their task, with spill; they are
read as a stream, and what is held is one window and its history. A very long
conversation is one stream, never one group in memory. Turns come in the order
of turn, role, text; equal rows are turns of their own. Null texts and roles
are empty. Rows whose conversation id is null are one conversation. An empty
table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._vocab import library_encoder
from thicket.llm._words import chunks, tidy

BUDGET, HISTORY = 2048, 256
#: Control strings: <| </s> <s> [INST] [/INST], by first character and rest.
_CONTROL = r"(?=\||/?s>|/?INST\])"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|([^|]*)\|>(.*?)</s>", re.S)
WINDOW_SCHEMA = "window int, first_turn long, n_context int, text string, loss_start array<int>, loss_end array<int>, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


def head(role: str) -> str:
    return f"<|{quote(role, safe='')}|>"


def written(role: str, text: str) -> str:
    """A turn as windows have it."""
    return f"{head(role)}{escape(text)}</s>"


def render(turns: list[Turn], context: int) -> tuple[str, list[int], list[int]]:
    """Text of a window and the spans of loss, in code points."""
    out, at, start, end = [], 0, [], []
    for i, t in enumerate(turns):
        mark, body = head(t.role), escape(t.text)
        if i >= context and t.role == "assistant":
            start.append(at + len(mark))
            end.append(at + len(mark) + len(body))
        out += [mark, body, "</s>"]
        at += len(mark) + len(body) + 4
    return "".join(out), start, end


class Windows:
    """Cuts one conversation, turn after turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.new: list[Turn] = []
        self.done = self.count = 0
        self.held = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        self.new.append(turn)
        self.held += turn.tokens
        if self.held > 4 * self.budget:
            yield from self.cut(False)

    def cut(self, final: bool) -> Iterator[tuple]:
        """Windows of the turns held; the last waits for more unless final."""
        while self.new:
            context = [self.system] if self.system is not None else []
            before, room = [], min(self.history, self.budget - sum(t.tokens for t in context) - self.new[0].tokens)
            for t in reversed(self.past):
                if t is not self.system and t.tokens <= room:
                    before.append(t)
                    room -= t.tokens
                else:
                    break
            context += reversed(before)
            used = sum(t.tokens for t in context)
            prefix = np.cumsum([t.tokens for t in self.new])
            n = max(1, int(np.searchsorted(prefix, self.budget - used, side="right")))
            if n == len(self.new) and not final:
                return
            span, self.new = self.new[:n], self.new[n:]
            text, start, end = render(context + span, len(context))
            total = used + int(prefix[n - 1])
            yield (self.count, self.done, len(context), text, start, end, total, total > self.budget)
            self.count, self.done = self.count + 1, self.done + n
            self.held -= int(prefix[n - 1])
            for t in span:
                if t.role == "system":
                    self.system = t
            self.past += span
            keep, size = len(self.past), 0
            while keep and size <= self.history:
                keep -= 1
                size += self.past[keep].tokens
            self.past = self.past[keep:]


def _batch(ids: list, rows: list[tuple], id_type: pa.DataType, id_col: str) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.bool_()]
    names = ["window", "first_turn", "n_context", "text", "loss_start", "loss_end", "n_tokens", "over_budget"]
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [id_col, *names])


def format_conversations(
    turns: DataFrame, tokenizer_path: str, budget: int = BUDGET, history_tokens: int = HISTORY,
    id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Windows of every conversation, in order within each partition."""
    kind = dict(turns.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, state = library_encoder(tokenizer_path), (False, None), None
        ids: list = []
        rows: list[tuple] = []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            every = [(name, r or "", t or "") for name, r, t in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            for chunk in chunks(pa.array([written(r, t) for _, r, t in every], pa.large_string())):
                _, off, _ = encoder.encode(chunk)
                names, roles, texts = zip(*every[chunk.first : chunk.first + len(chunk)])
                for name, r, t, n in zip(names, roles, texts, np.diff(off).tolist()):
                    if (True, name) != now:
                        if state is not None:
                            for w in state.cut(True):
                                ids.append(now[1])
                                rows.append(w)
                        now, state = (True, name), Windows(budget, history_tokens)
                    for w in state.add(Turn(r, t, n)):
                        ids.append(name)
                        rows.append(w)
                if rows:
                    yield _batch(ids, rows, id_type, id_col)
                    ids, rows = [], []
        if state is not None:
            for w in state.cut(True):
                ids.append(now[1])
                rows.append(w)
            if rows:
                yield _batch(ids, rows, id_type, id_col)

    cols = [F.col(f"`{c}`") for c in (id_col, turn, role, text)]
    ordered = turns.select(*(c.alias(a) for c, a in zip(cols, ("_id", "_turn", "_role", "_text")))).repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")
    return ordered.select("_id", "_role", "_text").mapInArrow(tidy(run), f"`{id_col}` {kind}, {WINDOW_SCHEMA}")


def parse_window(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    return [(unquote(r), unescape(t)) for r, t in _TURN.findall(text)]


def digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation, read back from windows as they were formatted:
    turns (context left out) and the text under loss, as counts and hashes."""
    kind = dict(windows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, chars, loss = (False, None), 0, 0, 0
        of_turns, of_loss, out = hashlib.sha256(), hashlib.sha256(), []
        id_type = None

        def flush() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, context, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if (True, name) != now:
                    if now[0]:
                        out.append((now[1], n, of_turns.hexdigest(), loss, of_loss.hexdigest(), chars))
                    now, n, chars, loss = (True, name), 0, 0, 0
                    of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
                for r, t in parse_window(text)[context:]:
                    of_turns.update(f"{r}\n{t}\n".encode())
                    n += 1
                for a, b in zip(start, end):
                    target = unescape(text[a:b])
                    of_loss.update(target.encode())
                    loss += len(target)
                chars += len(text)
            if out:
                yield flush()
        if now[0]:
            out.append((now[1], n, of_turns.hexdigest(), loss, of_loss.hexdigest(), chars))
            yield flush()

    schema = f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return windows.select(F.col(f"`{id_col}`"), "n_context", "text", "loss_start", "loss_end").mapInArrow(tidy(run), schema)
