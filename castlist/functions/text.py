"""Column expressions over plain strings: whitespace, sizes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set. Spark's trim knows only U+0020 and
# Java's \s only ASCII, so every strip and every \s goes through this list.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set for use inside a regex character class.
WS_SET = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A"
    r"\u2028\u2029\u202F\u205F\u3000"
)
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unix_newlines(text: Column) -> Column:
    """Turn CRLF, then any CR left, into LF."""
    return F.replace(
        F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")
    )


def byte_length(text: Column) -> Column:
    """Size of the text in UTF-8 bytes."""
    return F.octet_length(text)


def count_substring(text: Column, needle: Column) -> Column:
    """Non-overlapping, case-sensitive occurrences of a non-empty literal."""
    removed = F.octet_length(text) - F.octet_length(
        F.replace(text, needle, F.lit(""))
    )
    return (removed / F.octet_length(needle)).cast("int")


def line_count(text: Column) -> Column:
    """Number of LF characters plus one; an empty text has one line."""
    return count_substring(text, F.lit("\n")) + F.lit(1)


def size_kb(n_bytes: Column) -> Column:
    """Bytes to KiB, as a double."""
    return n_bytes / F.lit(1024.0)


def profile_label(name: Column, kb: Column, lines: Column, encoding: Column) -> Column:
    """One-line file description: name, KB with one decimal, lines, encoding.

    Halves are rounded to the even digit, on the exact decimal value.
    """
    rounded = F.bround(kb.cast("decimal(28,10)"), 1).cast("decimal(20,1)")
    return F.concat_ws(
        " | ",
        name,
        F.concat(rounded.cast("string"), F.lit(" KB")),
        F.concat(lines.cast("string"), F.lit(" lines")),
        encoding,
    )


def with_name_suffix(path: Column, suffix: str) -> Column:
    """Insert a suffix into the file name, before its last extension.

    A leading dot or a trailing dot is part of the stem, so ``.hidden`` and
    ``story.`` have no extension.
    """
    parts = r"(?s)^(.*/)?(.[^/]*?)(\.[^./]+)?\z"
    return F.concat(
        F.regexp_extract(path, parts, 1),
        F.regexp_extract(path, parts, 2),
        F.lit(suffix),
        F.regexp_extract(path, parts, 3),
    )


def processed_path(path: Column) -> Column:
    """Where the renamed version of a file goes."""
    return with_name_suffix(path, "_processed")


def normalized_path(path: Column) -> Column:
    """Where the layout-repaired version of a file goes."""
    return with_name_suffix(path, "_normalized")
