"""Chat formatting with a grammar round trip.

A conversation is rendered, the rendered text is parsed again by a deterministic parser, and the
turns it gives are compared with the source. Where they differ, the conflicting texts are escaped
and the conversation is rendered again, until the turns are identical.

Grammar (one space belongs to the marker on either side of a text)::

    user       <s>[INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant  (space) text </s>
    any other  [TURN:role] text [/TURN]

A marker with backslashes directly before it is text: the parser drops one of them. Escaping adds
one backslash to every marker in a text, so it is undone exactly whatever the text holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"(\\*)(<s>|</s>|\[/?INST\]|\[/?SYS\]|\[TURN:[^\]\s]*\]|\[/TURN\])")
_OPENED = {"[INST]": ("user", "[/INST]"), "[SYS]": ("system", "[/SYS]")}

_FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """The rendered text is no sequence of turns."""


def escape(text: str) -> str:
    return _MARK.sub(r"\\\1\2", text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns as they are, and the spans of assistant texts in it."""
    out, at, loss = [], 0, []
    for role, text in turns:
        if role == "assistant":
            before, after = " ", " </s>"
        elif role == "user":
            before, after = "<s>[INST] ", " [/INST]"
        elif role == "system":
            before, after = "[SYS] ", " [/SYS]"
        else:
            before, after = f"[TURN:{quote(role, safe='')}] ", " [/TURN]"
        if role == "assistant":
            loss.append((at + len(before), at + len(before) + len(text)))
        out += before, text, after
        at += len(before) + len(text) + len(after)
    return "".join(out), loss


def _tokens(formatted: str) -> Iterator[tuple[str, int, int, bool]]:
    """Text (False) and markers (True) in order, with their places; escapes undone."""
    at, begin, text = 0, 0, []
    for hit in _MARK.finditer(formatted):
        if hit[1]:
            text += formatted[at : hit.start()], hit[0][1:]
            at = hit.end()
            continue
        text.append(formatted[at : hit.start()])
        if hit.start() > begin:
            yield "".join(text), begin, hit.start(), False
        yield hit[0], hit.start(), hit.end(), True
        at = begin = hit.end()
        text = []
    if begin < len(formatted):
        yield "".join([*text, formatted[at:]]), begin, len(formatted), False


def parse(formatted: str) -> tuple[list[Turn], list[tuple[int, int]]]:
    """Turns of a rendered text, unescaped, and the spans of assistant texts; ``NotInGrammar`` otherwise."""
    turns: list[Turn] = []
    loss: list[tuple[int, int]] = []
    tokens = _tokens(formatted)

    def inside(token: tuple[str, int, int, bool] | None, close: str, role: str) -> None:
        if token is None or token[3]:
            raise NotInGrammar("a turn must hold its text")
        text, start, end, _ = token
        if len(text) < 2 or text[0] != " " or text[-1] != " ":
            raise NotInGrammar("a text stands between two spaces")
        closing = next(tokens, None)
        if closing is None or not closing[3] or closing[0] != close:
            raise NotInGrammar(f"{close} is missing")
        turns.append((role, text[1:-1]))
        if role == "assistant":
            loss.append((start + 1, end - 1))

    while (token := next(tokens, None)) is not None:
        value, _, _, marker = token
        if not marker:
            inside(token, "</s>", "assistant")
            continue
        if value == "<s>":
            token = next(tokens, None)
            if token is None or token[0] != "[INST]" or not token[3]:
                raise NotInGrammar("<s> must be followed by [INST]")
            inside(next(tokens, None), "[/INST]", "user")
        elif value == "[SYS]":
            inside(next(tokens, None), "[/SYS]", "system")
        elif value.startswith("[TURN:"):
            inside(next(tokens, None), "[/TURN]", unquote(value[6:-1]))
        else:
            raise NotInGrammar(f"{value} opens no turn")
    return turns, loss


def round_trip(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Rendered text whose parse gives the turns back, and its assistant spans.

    Texts are escaped only where the parse differs from the source at them; where the text can't be
    parsed at all, every text with a marker is.
    """
    shown = list(turns)
    while True:
        formatted, loss = render(shown)
        try:
            back, spans = parse(formatted)
        except NotInGrammar:
            back, spans = [], []
        if back == turns:
            if spans != loss:
                raise AssertionError("assistant spans differ from those rendered")
            return formatted, loss
        whole = len(back) == len(turns)
        tried = [
            (role, escape(text)) if now == text and (not whole or back[k] != (role, text)) else (role, now)
            for k, ((role, text), (_, now)) in enumerate(zip(turns, shown))
        ]
        if tried == shown:
            raise AssertionError("escaping did not make the conversation readable")
        shown = tried


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Turns of one conversation after another, from rows that are sorted by conversation."""
    current: int | None = None
    turns: list[Turn] | None = None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if turns is not None and conv != current:
                yield current, turns
                turns = None
            current = conv
            turns = turns if turns is not None else []
            turns.append((role, text))
    if turns is not None:
        yield current, turns


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (assistant texts in formatted, code points).

    Rows go by turn (null first), equal turns by role and text. Null roles and texts are empty;
    rows without a conversation are one conversation with a null id. Repeated rows are turns of
    their own. Other columns are ignored, whatever their names. A task holds one conversation.
    """
    empty = F.lit("")
    given = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"), F.col(turn_col).alias("turn"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([[{"start": a, "end": b} for a, b in h[2]] for h in held], spans)], ["conv_id", "formatted", "loss_spans"])

        for conv, turns in _conversations(batches):
            held.append((conv, *round_trip(turns)))
            size += len(held[-1][1])
            if size > 4 << 20:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _FORMATTED)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted texts finds: turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                turns, _ = parse(text)
                masked = "".join(value for s in spans for value, _, _, _ in _unmarked(text[s["start"] : s["end"]]))
                rows.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), _sha(masked), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, _DIGEST)


def _unmarked(text: str) -> list[tuple[str, int, int, bool]]:
    """A span of text, unescaped."""
    return list(_tokens(text))
