"""Splitting text into paragraphs, sentences and byte-limited pieces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from castlist.functions.text import WS, strip, unix_newlines

# Fixed value: the characters a sentence ends with.
SENTENCE_ENDS = "。！？；.!?;"


def paragraphs(text: Column) -> Column:
    """Ordered array of the paragraphs: runs of lines between blank lines."""
    parts = F.split(unix_newlines(text), rf"\n{WS}*\n+", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Ordered array of the sentences, without the whitespace between them."""
    parts = F.split(paragraph, rf"(?<=[{SENTENCE_ENDS}]){WS}*", -1)
    return F.filter(parts, lambda s: strip(s) != "")


def cut_by_bytes(text: str, max_bytes: int) -> list[str]:
    """Longest runs of whole characters that stay under max_bytes of UTF-8.

    A single character of max_bytes or more is still kept whole.
    """
    data = text.encode("utf-8")
    pieces = []
    start = 0
    while start < len(data):
        end = min(start + max_bytes - 1, len(data))
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= start:
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        pieces.append(data[start:end].decode("utf-8"))
        start = end
    return pieces


def byte_pieces(text: Column, max_bytes: int) -> Column:
    """Ordered array of the pieces of one text, each under max_bytes."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array(
            (None if t is None else cut_by_bytes(t, max_bytes) for t in texts.to_pylist()),
            pa.list_(pa.string()),
        )

    return cut(text)
