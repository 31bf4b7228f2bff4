"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its text alone is trainable. A conversation that does not end with
an assistant turn, or has none, gives one more example without a target, which holds all its turns, so
nothing of the conversation is lost.

A turn is written as ``### <role>: <text> </turn>`` and a line feed. In roles and texts a
backslash goes before every character that could begin or end a mark: ``\\``, ``#``, ``<``
and, in roles, ``:``. Every written character keeps its own, so the escape is undone by
removing the backslash from each pair, and ``### `` and ``</turn>`` occur only as marks.

Turns of a conversation are in the order of turn, role and text, nulls first; repeated rows stay. A null role or text counts as
empty. Rows without a conv_id form one conversation. No rows give no rows; further columns are
not carried over.

The result of an expansion is quadratic in the turns of a conversation by its definition. It
is built by a stream over sorted rows: a task holds the text of one conversation and a batch
of examples, never a conversation's examples together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
BATCH_CHARS = 4 << 20

EXAMPLES = (
    "conv_id long, example int, last boolean, n_turns int, formatted string, loss_start int, loss_end int"
)
_TURN = re.compile(
    r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*) </turn>\n", re.S
)
_PAIR = re.compile(r"\\(.)", re.S)


def escaped(text: Column, marks: str = "#<") -> Column:
    return F.regexp_replace(text, f"([\\\\{marks}])", r"\\$1")


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (conv_id, is_target, head, body), sorted, to examples without ``last``; None after a conversation's last."""
    started, conv, parts, length, number, pending = False, None, [], 0, 0, False
    for rows in batches:
        for key, target, head, body in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if started and key != conv:
                if pending:
                    yield conv, number, len(parts), "".join(parts), length, length
                yield None
            if not started or key != conv:
                started, conv, parts, length, number = True, key, [], 0, 0
            parts.append(head + body + CLOSE)
            pending = not target
            if target:
                start = length + len(head)
                yield conv, number, len(parts), "".join(parts), start, start + len(body)
                number += 1
            length += len(parts[-1])
    if pending:
        yield conv, number, len(parts), "".join(parts), length, length
    if started:
        yield None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of examples, of a bounded number of characters."""
    fields = [field.split()[0] for field in EXAMPLES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    out: list[tuple] = []
    held, size = None, 0
    for example in _examples(batches):
        if held is not None:
            out.append((*held[:2], example is None, *held[2:]))
            size += len(held[3])
        held = example
        if size >= BATCH_CHARS:
            yield _batch(out, types, fields)
            out, size = [], 0
    if out:
        yield _batch(out, types, fields)


def _batch(rows: list[tuple], types: list, fields: list[str]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], fields)


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of conversation rows (conv_id, turn, role, text), as in ``EXAMPLES``.

    loss_start and loss_end bound the trainable code points of ``formatted``.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    ordered = (
        conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select(
        "conv_id",
        (role == ASSISTANT).alias("target"),
        F.concat(F.lit(OPEN), escaped(role, "#<:"), F.lit(COLON)).alias("head"),
        escaped(text).alias("body"),
    ).mapInArrow(_expand, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        got = rows.to_pydict()
        turns, losses = [], []
        for last, text, start, end in zip(
            got["last"], got["formatted"], got["loss_start"], got["loss_end"], strict=True
        ):
            losses.append(unescape(text[start:end]))
            turns.append("".join(f"{r}\n{t}\n" for r, t in parse(text)) if last else None)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(got["conv_id"], pa.int64()),
                pa.array(got["example"], pa.int32()),
                pa.array(got["n_turns"], pa.int32()),
                pa.array(turns, pa.string()),
                pa.array(losses, pa.string()),
                pa.array([len(t) for t in got["formatted"]], pa.int64()),
            ],
            ["conv_id", "example", "n_turns", "turns", "loss", "chars"],
        )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars), parsed from the formatted examples.

    ``turns`` is role, line feed, text, line feed for every turn; ``loss`` all trainable text.
    """
    parsed = examples.select(
        "conv_id", "example", "last", "n_turns", "formatted", "loss_start", "loss_end"
    ).mapInArrow(
        _read_back, "conv_id long, example int, n_turns int, turns string, loss string, chars long"
    )
    return parsed.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns").alias("turns"),
        F.concat_ws("", F.array_sort(F.collect_list(F.struct("example", "loss")))["loss"]).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
