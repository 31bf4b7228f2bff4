"""Reading names out of model replies, and classifying failed requests."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.functions.text import WS, strip

# Where a names list may hide inside a longer reply.
FLAT_OBJECT = rf"\{{[^{{}}]*\"names\"{WS}*:{WS}*\[[^\]]*\][^{{}}]*\}}"
NAMES_ARRAY = rf"\"names\"{WS}*:{WS}*(\[[^\]]*\])"

# Rules for replies that are plain lists, one name per line.
SKIPPED_LINE_STARTS = ("{", "[", "```", "#", "-", "*")
LONGEST_NAME_LINE = 50
QUOTED_REPLY_LENGTH = 200
# Fixed value: what is said of a reply without readable names.
UNREADABLE_MESSAGE = "Could not extract names from response: "


def list_lines(reply: Column) -> Column:
    """Names of a reply that lists one per line; an empty array if none fit."""
    lines = F.transform(F.split(strip(reply), "\n", -1), strip)
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & (F.char_length(x) <= LONGEST_NAME_LINE)
        & ~_starts_with_any(x, SKIPPED_LINE_STARTS),
    )
    unnumbered = F.transform(
        kept,
        lambda x: strip(
            F.regexp_replace(
                F.regexp_replace(x, rf"^\p{{Nd}}+\.{WS}*", ""), rf"^[-*]{WS}*", ""
            )
        ),
    )
    return F.filter(unnumbered, lambda x: x != "")


def with_reply_names(replies: DataFrame) -> DataFrame:
    """Add ``names``, an array of the names in ``response`` in their order.

    NULL if the reply cannot be understood. Tried in turn: the reply as a JSON
    object, the first flat JSON object in it, the first names array in it, one
    name per line. A blank reply has no names and is not an error.

    JSON with nothing but strings is read by Catalyst. Only replies with other
    JSON (numbers, nesting, escaped or repeated keys) are handed to Python.
    Each step is a column of its own, so that it is computed once.
    """
    text = F.col("_text")
    wanted = F.col("_object")
    one_pair = (_occurrences(wanted, "{") == 1) & (_occurrences(wanted, "}") == 1)
    steps = (
        replies.withColumn("_text", strip(F.col("response")))
        .withColumn("_flat", F.regexp_extract(text, FLAT_OBJECT, 0))
        .withColumn("_object", F.when(text.startswith("{"), text).otherwise(F.col("_flat")))
        .withColumn(
            "_list",
            F.try_variant_get(F.when(one_pair, F.try_parse_json(wanted)), "$.names", "variant"),
        )
        .withColumn("_strings", _string_items(F.col("_list")))
    )
    unsure = F.col("_strings").isNull() & (text.contains('"names"') | text.contains("\\"))
    read = steps.withColumn(
        "_other",
        _decode_names(
            F.when(unsure, text),
            F.when(unsure, F.col("_flat")),
            F.when(unsure, F.regexp_extract(text, NAMES_ARRAY, 1)),
        ),
    )
    from_json = F.coalesce("_strings", "_other")
    found = read.withColumn(
        "_found", F.when(text != "", F.coalesce(from_json, list_lines(text)))
    )
    understood = from_json.isNotNull() | (F.size("_found") > 0)
    names = F.when(text == "", F.array().cast("array<string>")).when(understood, F.col("_found"))
    return found.withColumn("names", names).drop(
        "_text", "_flat", "_object", "_list", "_strings", "_other", "_found"
    )


def unreadable_reply(reply: Column) -> Column:
    """Error text for a reply without readable names."""
    return F.concat(
        F.lit(UNREADABLE_MESSAGE),
        F.substring(strip(reply), 1, QUOTED_REPLY_LENGTH),
    )


def is_rate_limit(error_class: Column, error: Column) -> Column:
    """True if a failed request was refused for exceeding the rate limit."""
    message = F.lower(error)
    return F.coalesce(
        F.lower(error_class).contains("ratelimit")
        | message.contains("rate limit")
        | message.contains("error code: 429"),
        F.lit(False),
    )


def _starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | text.startswith(prefix)
    return found


def _string_items(names: Column) -> Column:
    """The non-empty strings of a JSON list of strings and nulls, else NULL."""
    plain = F.schema_of_variant(names).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(
        plain, F.filter(F.try_variant_get(names, "$", "array<string>"), lambda n: n != "")
    )


def _occurrences(text: Column, char: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _listed_names(candidate: str | None, wrapped: bool) -> list[str] | None:
    """String forms of the truthy list items of one JSON candidate."""
    if not candidate:
        return None
    try:
        value = json.loads(candidate)
    except (ValueError, RecursionError):
        return None
    if wrapped:
        value = value.get("names") if isinstance(value, dict) else None
    if not isinstance(value, list):
        return None
    return [str(item).encode("utf-8", "replace").decode("utf-8") for item in value if item]


def _first_names(whole: pa.Array, flat: pa.Array, array: pa.Array) -> pa.Array:
    def first_readable(row):
        for candidate, wrapped in zip(row, (True, True, False)):
            names = _listed_names(candidate, wrapped)
            if names is not None:
                return names
        return None

    columns = (whole.to_pylist(), flat.to_pylist(), array.to_pylist())
    return pa.array((first_readable(row) for row in zip(*columns)), pa.list_(pa.string()))


# Declared nondeterministic so that no filter is pushed below with a copy of the call.
_decode_names = F.arrow_udf(_first_names, T.ArrayType(T.StringType())).asNondeterministic()
