"""Chat formatting in budgeted windows.

The turns of a conversation, in order, are cut into spans of whole turns by prefix sums of their token counts (those
of a tokenizer file; without one, about those). A window holds the system turn (if the conversation starts with one), a
limited history repeated from before, as far as it leaves room for the next turn, and as many new turns as fit the
budget, one at least (a turn that alone exceeds the budget has a window of its own, which then exceeds it too). Loss is on the text of new assistant turns only; repeated ones are masked.

Rows are dealt by conversation and sorted within partitions, so a window needs only the turns it holds: even a
conversation with a third of all rows streams through its task in bounded memory.

Template: <|turn|>role<|text|>text<|end|>, a line feed after each. Inside role and text, a backslash becomes two
and <| becomes <\\|, so no control string can occur there and unescaping gives back every text.

Defined results: null text and role are empty; null conv_id is one conversation of its own; turns with equal
numbers are ordered by role and text, and repeated rows stay repeated turns; an empty table gives no window; only the
columns of a window come back, so names of other columns can't clash; a text of any length is one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET, HISTORY = 512, 128
#: Rows of output that are held before they are handed on.
FLUSH = 500

_TOKENS = re.compile(r"\w{1,6}|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def count_tokens(text: str) -> int:
    """About the tokens of a text: word pieces of up to six characters and single marks."""
    return len(_TOKENS.findall(text))


def counter(tokenizer: str | None) -> Callable[[str], int]:
    """Tokens of a text, by a tokenizer file or about."""
    if tokenizer is None:
        return count_tokens
    return lambda text: codec(tokenizer).encode(text)[2]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The window's string and the code point spans under the loss mask."""
    out, at, spans = [], 0, []
    for role, text, target in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if target:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parsed(window: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, where the escaped text starts) of each turn in a window."""
    at = 0
    while at < len(window):
        head = window.index(TEXT, at)
        end = window.index(END, head)
        yield unescape(window[at + len(TURN) : head]), unescape(window[head + len(TEXT) : end]), head + len(TEXT)
        at = end + len(END) + 1


def spans_of(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Callable[[str], int]) -> Iterator[tuple[int, list[tuple[str, str, bool]]]]:
    """(number of repeated turns, turns) of each window; a turn is (role, text, under the loss mask)."""
    system: list[tuple[str, str]] = []
    system_size = 0
    new: list[tuple[str, str]] = []
    sums = [0]  # prefix sums over the repeated and the new turns of the window
    old: list[tuple[str, str]] = []
    first = True

    def window() -> tuple[int, list[tuple[str, str, bool]]]:
        repeated = (system if not first_window else []) + old
        return len(repeated), [(r, t, False) for r, t in repeated] + [(r, t, r == "assistant") for r, t in new]

    first_window = True
    for role, text in turns:
        size = count(text)
        if new and system_size * (not first_window) + sums[-1] + size > budget:
            yield window()
            # The longest run of last turns that fits the history, without the system turn, from the prefix sums.
            seen = old + new
            start = len(seen)
            while start > 0 and sums[-1] - sums[start - 1] <= history and not (first_window and system and start == 1):
                start -= 1
            # The oldest of these go until the next turn fits.
            while start < len(seen) and system_size + sums[-1] - sums[start] + size > budget:
                start += 1
            old = seen[start:]
            sums = [x - sums[start] for x in sums[start:]]
            new, first_window = [], False
        if first and role == "system":
            system, system_size = [(role, text)], size
        first = False
        new.append((role, text))
        sums.append(sums[-1] + size)
    if new:
        yield window()


SCHEMA = "conv_id {id}, window int, n_repeated int, text string, loss array<struct<start:int,end:int>>"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with equal first column, each streamed."""
    ahead = next(rows, None)
    while ahead is not None:
        key, held = ahead[0], [ahead]

        def run() -> Iterator[tuple]:
            while held:
                yield held.pop()
                row = next(rows, None)
                if row is not None and row[0] == key:
                    held.append(row)
                else:
                    held_next.append(row)

        held_next: list = []
        group = run()
        yield key, group
        for _ in group:  # what the reader left
            pass
        ahead = held_next[0] if held_next else None


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per window: conv_id, window, n_repeated, text and the spans of text under the loss mask.

    tokenizer: the file by which tokens are counted (as `bpe` encodes); about, if there is none.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None
        count = counter(tokenizer)

        def flush() -> pa.RecordBatch:
            loss = pa.array([[{"start": a, "end": b} for a, b in x[4]] for x in held], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array([x[0] for x in held], schema), pa.array([x[1] for x in held], pa.int32()), pa.array([x[2] for x in held], pa.int32()), pa.array([x[3] for x in held], pa.string()), loss]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "window", "n_repeated", "text", "loss"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema.field(0).type
                yield batch

        for conv, turns in _groups(_streamed(typed())):
            for number, (repeated, own) in enumerate(spans_of(((r[2], r[3]) for r in turns), budget, history, count)):
                text, loss = formatted(own)
                held.append((conv, number, repeated, text, loss))
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()
        if tokenizer is not None:  # a worker outlives its task
            codec(tokenizer).known.empty()

    return dealt.mapInArrow(run, SCHEMA.format(id=kind))


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """A row per conversation, from its windows alone: turns and loss text are parsed out of the strings.

    Hashes are fed window by window, so no conversation is held whole.
    """
    kind = formatted_windows.schema["conv_id"].dataType.simpleString()
    dealt = formatted_windows.select("conv_id", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        schema = pa.int64()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema.field(0).type
                yield batch

        for conv, own in _groups(_streamed(typed())):
            turns, losses, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, repeated, text, loss in own:
                chars += len(text)
                for i, (role, body, _) in enumerate(parsed(text)):
                    if i >= repeated:
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    plain = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(plain)
                    losses.update(plain.encode("utf-8", "surrogatepass"))
            kept.append((conv, n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars))
            if len(kept) >= FLUSH:
                yield batch_of(kept, schema)
                kept = []
        if kept:
            yield batch_of(kept, schema)

    def batch_of(rows: list[tuple], schema) -> pa.RecordBatch:
        kinds = [schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
