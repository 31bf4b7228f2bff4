"""Layout repair: line predicates as Column expressions, and the text repair."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.functions.text import NOT_WS, WHITESPACE, strip

# Chapter headings, sentence ends with their closing marks, and
# the characters that count as indentation.
NUMERALS = "0-9一二三四五六七八九十百千零两"
UNITS = "章节回卷部篇"
ENDINGS = "。！？!?…"
CLOSERS = "\"”’」』）】》"
INDENT = " \t\u3000"

TITLE = f"^第[{NUMERALS}]+[{UNITS}]"
ENDED = f"[{ENDINGS}][{CLOSERS}]*\\n?\\z"


def is_chapter_title(line: Column) -> Column:
    """True for a single line such as ``第十二章 …`` (outer whitespace ignored)."""
    return strip(line).rlike(TITLE + r"[^\n]*\z")


def starts_new_paragraph(previous: Column, following: Column) -> Column:
    """True if a break between the two lines should be kept.

    An ASCII full stop is not a sentence end here.
    """
    return is_chapter_title(previous) | previous.rlike(ENDED) | is_chapter_title(following)


def join_wrapped(previous: Column, following: Column) -> Column:
    """Glue two lines; one space only between ASCII letters or digits."""
    words = previous.rlike(r"[0-9A-Za-z]\z") & following.rlike("^[0-9A-Za-z]")
    return F.concat(previous, F.when(words, F.lit(" ")).otherwise(F.lit("")), following)


def fullwidth_indent(line: Column) -> Column:
    """The run of U+3000 at column 0, or an empty string."""
    return F.regexp_extract(line, "^(\u3000+)", 1)


def is_indented(line: Column) -> Column:
    """True if at least two indentation characters precede the text."""
    return line.rlike(f"^[{INDENT}]{{2,}}{NOT_WS}")


_title_start = re.compile(f"第[{NUMERALS}]+[{UNITS}]")
_title_so_far = re.compile(f"第[{NUMERALS}]*")
_indented = re.compile(f"[{INDENT}]{{2,}}\\S")
_ASCII_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def repair_layout_text(text: str) -> str:
    """Un-wrap the lines of one text, keeping the breaks that look intended.

    The break rules look at the whole paragraph read so far. Two facts about it
    are enough: whether it ends a sentence, and whether it opens as a chapter
    title. Both are carried along, so the cost is linear in the text.
    """
    out: list[str] = []
    gap = False  # blank line seen since the last text line
    ended = False  # the paragraph so far ends a sentence
    titled = False  # the paragraph so far is a chapter title
    opening: str | None = ""  # its start, while it may still become a title
    last = ""  # its last character
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = raw.strip(INDENT)
        if not line:
            gap = True
            continue
        glue = ""
        fresh = not out
        if not fresh and (gap or _indented.match(raw)):
            if ended or titled or _title_start.match(line.strip()):
                fresh = True
                glue = "\n\n" if gap else "\n"
        if fresh:
            indent = raw[: len(raw) - len(raw.lstrip("\u3000"))]
            opening = line.lstrip(WHITESPACE)
            ended = False
            out.append(glue + indent + line)
        else:
            if last in _ASCII_WORD and line[0] in _ASCII_WORD:
                glue = " "
            if opening is not None:
                opening = (opening + glue + line).lstrip(WHITESPACE)
            out.append(glue + line)
        if opening is not None:
            titled = _title_start.match(opening) is not None
            if opening and not _title_so_far.fullmatch(opening):
                opening = None  # decided for the rest of the paragraph
        # a line of nothing but closing marks leaves a sentence as ended as it was
        spoken = line.rstrip(CLOSERS)
        ended = spoken[-1] in ENDINGS if spoken else ended
        last = line[-1]
        gap = False
    return "".join(out)


@F.arrow_udf(T.StringType())
def _repair_layout(texts: pa.Array) -> pa.Array:
    return pa.array(
        (None if t is None else repair_layout_text(t) for t in texts.to_pylist()), pa.string()
    )


def repair_layout(text: Column) -> Column:
    """Layout repair of a whole text; order-dependent, so one Arrow pass per row."""
    return _repair_layout(text)
