"""Names of documents: parsed replies, deduplication, counts, outcome of a run."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castlist.functions import replies
from castlist.functions.text import strip
from castlist.operators import matching
from castlist.operators.asking import NOT_ASKED, NOT_ASKED_MESSAGE
from castlist.operators.rows import explode_items, inline_structs
from castlist.operators.skew import ROWS_PER_TASK, heavy_keys
from castlist.session import bounded_batches


# Above this many character comparisons (names x text length) one pass of an
# automaton beats one search per name. Both give the same counts.
AUTOMATON_WORK = 200_000

# What a run says that ended without names.
RATE_LIMIT_MESSAGE = "Rate limit exceeded. Please wait and retry."
RATE_LIMIT_DETAILS = "Provider rate limit."
FAILED_MESSAGE = ("All ", " chunk(s) failed")
STOPPED_MESSAGE = " chunk(s) not asked"


def parse_replies(responses: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_idx, response, names, error_class, error).

    ``names`` is NULL where the request failed or its reply is unreadable.
    """
    read = replies.with_reply_names(responses)
    unreadable = F.col("response").isNotNull() & F.col("names").isNull()
    return read.select(
        "doc_id",
        "chunk_idx",
        "response",
        "names",
        F.when(unreadable, F.lit("ValueError")).otherwise(F.col("error_class")).alias("error_class"),
        F.when(unreadable, replies.unreadable_reply(F.col("response")))
        .otherwise(F.col("error"))
        .alias("error"),
    )


def distinct_names(names: Column) -> Column:
    """Stripped, non-empty, distinct names of one array, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(names, strip), lambda n: n != ""))


def dedupe_names(parsed: DataFrame) -> DataFrame:
    """Rows (doc_id, name, first_chunk, first_pos): distinct names of a document.

    First-seen order is (first_chunk, first_pos). Grouped by document and name
    with partial aggregation, so a document of many chunks is spread out. The
    two places are minimised as one number, which hash aggregation can hold.
    """
    place = F.shiftleft(F.col("chunk_idx").cast("bigint"), 32) + F.col("pos")
    mentions = explode_items(
        parsed, ["doc_id", "chunk_idx"], F.col("names"), "pos", "raw"
    ).withColumn("name", strip(F.col("raw")))
    return (
        mentions.where(F.col("name") != "")
        .groupBy("doc_id", "name")
        .agg(F.min(place).alias("first"))
        .select(
            "doc_id",
            "name",
            F.shiftright("first", 32).cast("int").alias("first_chunk"),
            F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("first_pos"),
        )
    )


def count_all(text: str, names: list[str]) -> list[int]:
    """Non-overlapping occurrences of every name, each counted on its own.

    An empty or missing name occurs nowhere.
    """
    if len(names) * len(text) < AUTOMATON_WORK:
        return [text.count(name) if name else 0 for name in names]
    counts = dict.fromkeys(names, 0)
    free_from = dict.fromkeys(names, 0)
    automaton = ahocorasick.Automaton()
    for name in filter(None, counts):
        automaton.add_word(name, name)
    if not len(automaton):
        return [0] * len(names)
    automaton.make_automaton()
    for end, name in automaton.iter(text):
        if end - len(name) + 1 >= free_from[name]:
            counts[name] += 1
            free_from[name] = end + 1
    return [counts[name] for name in names]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _count_all(texts: pa.Array, names: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), names.to_pylist())
    return pa.array(
        (None if t is None or n is None else count_all(t, n) for t, n in rows),
        pa.list_(pa.int32()),
    )


def count_in_text(text: Column, names: Column) -> Column:
    """Occurrences of each of an array of non-empty names in a text, aligned."""
    return _count_all(text, names)


def count_own_names(docs: DataFrame, top: int | None = None) -> DataFrame:
    """Rows (doc_id, name, occurrences, rank) from (doc_id, text, names).

    For names that were read off the row's own text: the array is no larger
    than the text, so counting and ranking happen inside the row, without a
    shuffle. Order and rank are those of ``castlist.operators.mapping``; with
    ``top``, only the first that many names of each document become rows.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select("doc_id", "text", distinct_names(F.col("names")).alias("names"))
    counted = named.select(
        "doc_id", "names", count_in_text(F.col("text"), F.col("names")).alias("counts")
    )
    pairs = F.zip_with(
        "names", "counts", lambda name, n: F.struct((-n).alias("minus_n"), name.alias("name"))
    )
    ordered = F.sort_array(pairs)
    if top is not None:
        ordered = F.slice(ordered, 1, top)
    return explode_items(counted, ["doc_id"], ordered, "pos", "pair").select(
        "doc_id",
        F.col("pair.name").alias("name"),
        (-F.col("pair.minus_n")).alias("occurrences"),
        (F.col("pos") + 1).alias("rank"),
    )


def count_occurrences(
    docs: DataFrame,
    names: DataFrame,
    broadcast_bytes: int = matching.BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows (doc_id, name, occurrences) for rows (doc_id, name).

    Names are stripped; empty and missing ones are dropped and repeated ones
    counted once. Counted in the whole text of the document; zero counts are
    kept. ``names`` is measured first and so read more than once: pass a stored
    table.
    """
    bounded_batches(docs.sparkSession)
    items = names.select("doc_id", strip(F.col("name")).alias("name")).where(F.col("name") != "")
    small = matching.fits_broadcast(items, broadcast_bytes)
    heavy = None if small else heavy_keys(items, "doc_id", rows_per_task)
    texts = docs.select("doc_id", "text")
    listed = matching.with_item_lists(texts, items, ["name"], small, "inner", heavy, F.collect_set)
    lists = listed.select("doc_id", "text", F.col("items.name").alias("names"))
    counted = lists.select(
        "doc_id", "names", count_in_text(F.col("text"), F.col("names")).alias("counts")
    )
    pairs = F.zip_with(
        "names", "counts", lambda name, n: F.struct(name.alias("name"), n.alias("occurrences"))
    )
    return inline_structs(counted, ["doc_id"], pairs, "name")


def chunk_summary(parsed: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_idx, n_names): names found in each readable chunk."""
    return parsed.where(F.col("names").isNotNull()).select(
        "doc_id", "chunk_idx", F.size("names").alias("n_names")
    )


def mention_totals(counts: DataFrame) -> DataFrame:
    """Rows (doc_id, unique_names, total_mentions)."""
    return counts.groupBy("doc_id").agg(
        F.count("name").alias("unique_names"),
        F.sum("occurrences").cast("bigint").alias("total_mentions"),
    )


def run_outcome(parsed: DataFrame) -> DataFrame:
    """One row per document with chunks: how its extraction ended.

    ``status`` is ``rate_limited`` if any chunk was, else ``stopped`` if some
    were not asked since a refusal elsewhere had stopped the run, else ``failed`` if no
    name was found and some chunk failed, else ``ok``. ``message`` and
    ``details`` are set for all but the last. Chunks not asked are not failed ones.
    """
    unasked = F.coalesce(F.col("error_class") == NOT_ASKED, F.lit(False))
    failed = F.col("error").isNotNull() & ~unasked
    limited = failed & replies.is_rate_limit(F.col("error_class"), F.col("error"))
    totals = parsed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(failed).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("names").isNotNull(), F.size("names"))), F.lit(0)).cast("bigint").alias("n_names"),
        F.bool_or(limited).alias("rate_limited"),
        F.count_if(unasked).alias("n_unasked"),
        F.min(F.when(failed, F.struct("chunk_idx", "error")))["error"].alias("first_error"),
    )
    status = (
        F.when(F.col("rate_limited"), "rate_limited")
        .when(F.col("n_unasked") > 0, "stopped")
        .when((F.col("n_names") == 0) & (F.col("n_failed") > 0), "failed")
        .otherwise("ok")
    )
    return totals.withColumn("status", status).select(
        "doc_id",
        "n_chunks",
        "n_failed",
        "n_names",
        "status",
        F.when(F.col("status") == "rate_limited", RATE_LIMIT_MESSAGE)
        .when(F.col("status") == "stopped", F.concat(F.col("n_unasked").cast("string"), F.lit(STOPPED_MESSAGE)))
        .when(
            F.col("status") == "failed",
            F.concat(F.lit(FAILED_MESSAGE[0]), F.col("n_failed").cast("string"), F.lit(FAILED_MESSAGE[1])),
        )
        .alias("message"),
        F.when(F.col("status") == "rate_limited", RATE_LIMIT_DETAILS)
        .when(F.col("status") == "stopped", NOT_ASKED_MESSAGE)
        .when(F.col("status") == "failed", F.col("first_error"))
        .alias("details"),
    )
