"""Texts longer than a cell: rows (doc_id, seg_idx, text), the segments of a document cut anywhere, in order.

No step sees a whole document. Units that a cut goes through, lines or paragraphs, move to the segment they start in;
only those pieces are grouped. What a segment does depends on those before it, through a small state at its start. Every
segment is summarised, by itself and in parallel, as a map from each state it may start in to the state it ends in; these maps
can be put together in order without the texts (``start_states``: a stream of summaries, sorted by segment, in
which a task keeps one state for a document). Then all segments are worked on in parallel again, each from its state.

doc_ids are unique to a document and not NULL, and seg_idx is unique in a document, as tables of documents are. A
missing segment text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castlist.functions.text import strip, unix_newlines
from castlist.operators.rows import explode_items
from castlist.session import cut_lineage

ALL = 2_147_483_647

# The numbers of a summary, and what follows from one state: the next state and a step to add up.
Follow = Callable[[int, list[int]], tuple[int, int]]


def cut_into_segments(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, seg_idx, text) of (doc_id, text): every ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(size))
    return explode_items(docs, ["doc_id", "text"], starts, "seg_idx", "start").select(
        "doc_id", "seg_idx", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text")
    )


def _moved(parts: DataFrame, glue: str) -> DataFrame:
    """Rows (doc_id, seg_idx, text) from (doc_id, seg_idx, head, rest, text): heads go to the end of where their unit starts.

    ``rest`` is NULL where a segment has no boundary, so that all of it is head; ``head`` is NULL where nothing is to be
    moved. A document's first segment keeps its whole ``text``. Segments that no unit starts in have no row.
    """
    order = Window.partitionBy("doc_id").orderBy("seg_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # The windows run over numbers alone, the texts stay out of them.
    numbers = parts.select("doc_id", "seg_idx", F.col("rest").isNotNull().alias("bounded")).select(
        "doc_id",
        "seg_idx",
        F.last(F.when(F.col("bounded"), F.col("seg_idx")), ignorenulls=True).over(earlier).alias("boundary"),
        F.first("seg_idx").over(order).alias("first"),
    )
    placed = parts.join(numbers, ["doc_id", "seg_idx"])
    opens = F.col("seg_idx") == F.col("first")
    own = placed.select("doc_id", "seg_idx", F.when(opens, F.col("text")).otherwise(F.col("rest")).alias("rest"))
    heads = placed.where(~opens & F.col("head").isNotNull())
    heads = heads.groupBy("doc_id", F.coalesce("boundary", "first").alias("owner"))
    moved = heads.agg(F.array_sort(F.collect_list(F.struct("seg_idx", "head"))).alias("heads")).select(
        "doc_id", F.col("owner").alias("seg_idx"), F.transform("heads", lambda h: h["head"]).alias("heads")
    )
    both = own.where(F.col("rest").isNotNull()).join(moved, ["doc_id", "seg_idx"], "left")
    texts = F.concat(F.array("rest"), F.coalesce("heads", F.array().cast("array<string>")))
    return both.select("doc_id", "seg_idx", F.array_join(texts, glue).alias("text"))


def whole_lines(segments: DataFrame) -> DataFrame:
    """Rows (doc_id, seg_idx, text), each of whole lines; joined by LF they are the text with LF for CRLF and CR."""
    order = Window.partitionBy("doc_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    given = segments.select("doc_id", "seg_idx", F.coalesce("text", F.lit("")).alias("text"))
    ends = given.select("doc_id", "seg_idx", F.when(F.col("text") != "", F.right("text", F.lit(1))).alias("end"))
    ends = ends.select("doc_id", "seg_idx", F.last("end", ignorenulls=True).over(order).alias("before"))
    # A CR that a cut has parted from its LF is a line end already.
    parted = (F.col("before") == "\r") & F.startswith("text", F.lit("\n"))
    joined = given.join(ends, ["doc_id", "seg_idx"])
    text = F.when(parted, F.substring("text", 2, ALL)).otherwise(F.col("text"))
    clean = joined.select("doc_id", "seg_idx", unix_newlines(text).alias("text"))
    at = F.locate("\n", F.col("text"))
    parts = clean.select(
        "doc_id",
        "seg_idx",
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("head"),
        F.when(at > 0, F.substring("text", at + 1, F.lit(ALL))).alias("rest"),
        "text",
    )
    return _moved(parts, "")


def whole_paragraphs(segments: DataFrame) -> DataFrame:
    """Rows (doc_id, seg_idx, text), each of whole paragraphs: runs of lines that are not blank."""
    split = cut_lineage(whole_lines(segments)).withColumn("lines", F.split("text", "\n", -1))
    at = F.array_position(F.transform("lines", lambda line: strip(line) == ""), True)
    # What stands before the first blank line belongs to a paragraph that may have begun earlier.
    found = split.select("doc_id", "seg_idx", "text", "lines", at.cast("int").alias("at"))
    cut = lambda first, n: F.array_join(F.slice("lines", first, n), "\n")
    parts = found.select(
        "doc_id",
        "seg_idx",
        F.when(F.col("at") == 0, F.col("text")).when(F.col("at") > 1, cut(F.lit(1), F.col("at") - 1)).alias("head"),
        F.when(F.col("at") > 0, cut(F.col("at"), F.size("lines"))).alias("rest"),
        "text",
    )
    return _moved(parts, "\n")


def start_states(summaries: DataFrame, first: int, follow: Follow) -> DataFrame:
    """Rows (doc_id, seg_idx, state, before) from (doc_id, seg_idx, summary): what each segment starts with.

    ``follow`` gives from a state and a summary the next state and a number, and ``before`` is the sum of these numbers over the segments
    before. A task streams through the summaries of its documents and keeps one state.
    """
    kind = summaries.schema["doc_id"].dataType.simpleString()
    ordered = summaries.select("doc_id", "seg_idx", "summary").repartition("doc_id").sortWithinPartitions("doc_id", "seg_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, total, begun = None, first, 0, False
        for batch in batches:
            states, totals = [], []
            for own, summary in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or own != doc:
                    doc, state, total, begun = own, first, 0, True
                states.append(state)
                totals.append(total)
                state, step = follow(state, summary)
                total += step
            columns = [batch.column(0), batch.column(1), pa.array(states, pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seg_idx", "state", "before"])

    return ordered.mapInArrow(run, f"doc_id {kind}, seg_idx int, state long, before long")


def with_states(segments: DataFrame, states: DataFrame) -> DataFrame:
    """The segments with what they start with."""
    return segments.join(states, ["doc_id", "seg_idx"])


def joined_segments(segments: DataFrame, glue: Column | str = "") -> DataFrame:
    """Rows (doc_id, text), for documents that fit a cell."""
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return segments.groupBy("doc_id").agg(parts.alias("parts")).select(
        "doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), glue).alias("text")
    )
