"""Names of every document: chunk, ask, parse, dedupe, count, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.operators import asking, chunks, mapping, names, scoring
from castlist.session import cut_lineage

# How many requests a task makes where the caller does not say into how many they are spread.
REQUESTS_PER_TASK = 1000


@dataclass(frozen=True)
class Extraction:
    """What an extraction leaves: all tables are keyed by doc_id.

    ``replies`` is stored: (doc_id, chunk_idx, response, names, error_class,
    error), one row per chunk.
    """

    replies: DataFrame
    outcome: DataFrame
    ranked: DataFrame


def extract_names(
    docs: DataFrame,
    make_fn: Callable[[], Callable[[str], str]],
    max_bytes: int = chunks.CHUNK_MAX_BYTES,
    template: str = scoring.DEFAULT_PROMPT,
    interval: float = 0.0,
    partitions: int | None = None,
    replies_path: str | None = None,
    names_path: str | None = None,
    log: str | None = None,
) -> Extraction:
    """Run the whole extraction over (doc_id, text).

    The requests are spread evenly over ``partitions``, so a long document does
    not hold one task. The default is measured: one partition for every
    ``REQUESTS_PER_TASK`` chunks that the bytes of all texts can fill. Pacing is
    per partition, so pass ``partitions`` together with ``interval``. With a folder for
    a ``log`` (see ``castlist.operators.asking``) the pace is that of the whole job, what an earlier run has logged is not
    asked again, and the first refusal stops the run: documents it left unfinished have the outcome ``stopped``.
    The replies are written down once, with the names read from them, because
    they are expensive and may differ when asked again; so are the distinct
    names, which are read several times. ``ranked`` holds (doc_id, name, occurrences, rank) of the documents
    whose outcome is ok; a document without chunks has an ok outcome too.
    """
    if partitions is None:
        if interval and log is None:
            raise ValueError("an interval is per partition: pass partitions with it")
        size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        partitions = size // (max_bytes * REQUESTS_PER_TASK) + 1
    chunked = chunks.split_into_chunks(docs, max_bytes)
    if log is None:
        answered = scoring.score_chunks(chunked, make_fn, template, interval, partitions)
    else:
        answered = asking.ask_chunks(chunked, make_fn, log, template, interval, partitions)
    replies = cut_lineage(names.parse_replies(answered), replies_path)
    ended = names.run_outcome(replies)
    outcome = docs.select("doc_id").join(ended, "doc_id", "left").select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_failed", "n_names")),
        F.coalesce("status", F.lit("ok")).alias("status"),
        "message",
        "details",
    )
    aborted = ended.where(F.col("status").isin("rate_limited", "stopped")).select("doc_id")
    distinct = names.dedupe_names(replies).join(aborted, "doc_id", "left_anti")
    found = cut_lineage(distinct, names_path)
    counted = names.count_occurrences(docs, found)
    return Extraction(replies, outcome, mapping.rank_names(cut_lineage(counted)))
