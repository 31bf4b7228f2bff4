"""Prompts, and the batch form of the model calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the default prompt.
DEFAULT_PROMPT = """You are a character name extractor. Given the following text excerpt, identify all character names (people's names, nicknames, titles used as names).

Rules:
- Only extract names of people/characters, not places or organizations
- Include full names, nicknames, and titles used to address characters
- Do not include generic titles like "先生" or "老师" unless they are part of a specific character's name
- Remove duplicates
- Output ONLY valid JSON in this exact format: {"names": ["Name1", "Name2", ...]}

Text:
{chunk_text}

Output only the JSON, nothing else:"""

SLOT = "{chunk_text}"
RESPONSES = "doc_id {id_type}, chunk_idx int, response string, error_class string, error string"


def prompt(chunk: Column, template: str = DEFAULT_PROMPT) -> Column:
    """The template with every slot filled in; nothing else is interpreted."""
    return F.replace(F.lit(template), F.lit(SLOT), chunk)


def score_chunks(
    chunks: DataFrame,
    make_fn: Callable[[], Callable[[str], str]],
    template: str = DEFAULT_PROMPT,
    interval: float = 0.0,
    partitions: int | None = None,
) -> DataFrame:
    """Rows (doc_id, chunk_idx, response, error_class, error), one per chunk.

    ``make_fn`` runs once per partition and returns the function that answers
    one prompt. A failing call becomes an error row, and is not repeated.
    ``interval`` is the least number of seconds between the starts of two calls
    of a partition; for a rate over the whole job, multiply it by the number of
    partitions. ``partitions`` spreads the calls, also those of one document,
    evenly; within a partition they run in document order.

    The result is not repeatable: write it down (see ``castlist.session``)
    before using it twice, and run without speculative execution.
    """
    if partitions is not None:
        chunks = chunks.repartition(partitions, "doc_id", "chunk_idx").sortWithinPartitions(
            "doc_id", "chunk_idx"
        )
    prompts = chunks.select("doc_id", "chunk_idx", prompt(F.col("chunk"), template).alias("prompt"))
    id_type = chunks.schema["doc_id"].dataType.simpleString()

    def call_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        started = None
        for batch in batches:
            answers = []
            for text in batch.column("prompt").to_pylist():
                if fn is None:
                    fn = make_fn()
                if started is not None and interval > 0:
                    time.sleep(max(0.0, started + interval - time.monotonic()))
                started = time.monotonic()
                try:
                    answers.append((fn(text) or "", None, None))
                except Exception as failure:  # any failure is a result row
                    answers.append((None, type(failure).__name__, str(failure)))
            response, error_class, error = zip(*answers) if answers else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("chunk_idx").cast(pa.int32()),
                    pa.array(response, pa.string()),
                    pa.array(error_class, pa.string()),
                    pa.array(error, pa.string()),
                ],
                ["doc_id", "chunk_idx", "response", "error_class", "error"],
            )

    return prompts.mapInArrow(call_all, RESPONSES.format(id_type=id_type))
