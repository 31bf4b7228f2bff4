"""Layout repair of texts longer than a cell: the fold over lines as a map between a few states.

What the fold of ``castlist.functions.layout`` knows of the lines before is: whether there was text; whether a
blank line followed; whether the paragraph ends a sentence; how it opens (nothing but white space, the mark of a title, that and
numerals, a title, or none); whether its last character is an ASCII letter or digit. These are 80 states, so the lines
of a segment are a map of 80 numbers, and maps are put together in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.functions.layout import CLOSERS, ENDINGS, INDENT, NUMERALS, UNITS
from castlist.functions.text import WHITESPACE
from castlist.operators import segments

_title = re.compile(f"第[{NUMERALS}]+[{UNITS}]")
_open = re.compile(f"第[{NUMERALS}]*")
_indented = re.compile(f"[{INDENT}]{{2,}}\\S")
_ASCII_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

# How a paragraph opens, and a beginning that stands for all that open so and may go on.
BLANK, MARK, NUMBERED, TITLE, PLAIN = range(5)
OPENINGS = {BLANK: "", MARK: "第", NUMBERED: "第一"}


class State(NamedTuple):
    """What the fold knows between two lines."""

    begun: bool = False
    gap: bool = False
    ended: bool = False
    opening: int = BLANK
    word: bool = False

    @property
    def number(self) -> int:
        return (((self.opening * 2 + self.begun) * 2 + self.gap) * 2 + self.ended) * 2 + self.word


STATES = [
    State(bool(n >> 3 & 1), bool(n >> 2 & 1), bool(n >> 1 & 1), n >> 4, bool(n & 1)) for n in range(80)
]


def _opening(text: str) -> int:
    if not text:
        return BLANK
    if _title.match(text):
        return TITLE
    if _open.fullmatch(text):
        return MARK if len(text) == 1 else NUMBERED
    return PLAIN


def step(state: State, raw: str) -> tuple[State, str]:
    """The state after one more line, and what the line adds to the text."""
    line = raw.strip(INDENT)
    if not line:
        return state._replace(gap=True), ""
    fresh, glue = not state.begun, ""
    if state.begun and (state.gap or _indented.match(raw)):
        if state.ended or state.opening == TITLE or _title.match(line.strip()):
            fresh, glue = True, "\n\n" if state.gap else "\n"
    if fresh:
        indent = raw[: len(raw) - len(raw.lstrip("\u3000"))]
        opening, ended, added = _opening(line.lstrip(WHITESPACE)), False, glue + indent + line
    else:
        if state.word and line[0] in _ASCII_WORD:
            glue = " "
        opening, ended, added = state.opening, state.ended, glue + line
        if opening in OPENINGS:
            opening = _opening((OPENINGS[opening] + added).lstrip(WHITESPACE))
    spoken = line.rstrip(CLOSERS)
    if spoken:
        ended = spoken[-1] in ENDINGS
    return State(True, False, ended, opening, line[-1] in _ASCII_WORD), added


def summary(lines: list[str]) -> list[int]:
    """The number of the state that the lines lead to from each state; states that meet go on as one."""
    leads = list(range(len(STATES)))
    for line in lines:
        after = {n: step(STATES[n], line)[0].number for n in set(leads)}
        leads = [after[n] for n in leads]
    return leads


def repair(lines: list[str], state: State) -> str:
    """What the lines add to the repaired text of the lines before."""
    out = []
    for line in lines:
        state, added = step(state, line)
        out.append(added)
    return "".join(out)


def follow(state: int, leads: list[int]) -> tuple[int, int]:
    return leads[state], 0


def repair_segments(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seg_idx, text) from (doc_id, seg_idx, text): joined they are the repaired text of the joined segments."""
    lines = segments.whole_lines(rows)

    @F.arrow_udf("array<int>")
    def summarised(texts: pa.Array) -> pa.Array:
        return pa.array([summary(text.split("\n")) for text in texts.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf("string")
    def repaired(texts: pa.Array, states: pa.Array) -> pa.Array:
        pairs: Iterator[tuple[str, int]] = zip(texts.to_pylist(), states.to_pylist())
        return pa.array([repair(text.split("\n"), STATES[n]) for text, n in pairs], pa.string())

    summaries = lines.select("doc_id", "seg_idx", summarised("text").alias("summary"))
    states = segments.start_states(summaries, State().number, follow)
    placed = segments.with_states(lines, states)
    return placed.select("doc_id", "seg_idx", repaired("text", "state").alias("text"))
