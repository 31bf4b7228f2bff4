"""Chunking documents under a UTF-8 byte limit."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.functions import splitting
from castlist.functions.splitting import cut_by_bytes
from castlist.operators.rows import explode_items

# Fixed value: the default limit, 16 KiB; a chunk stays strictly below it.
CHUNK_MAX_BYTES = 16 * 1024

SEPARATOR = "\n\n"
CUTS = "array<struct<first:int,n:int,piece:string>>"


def explode_paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, para_idx, text), one per paragraph."""
    return explode_items(
        docs, ["doc_id"], splitting.paragraphs(F.col("text")), "para_idx", "text"
    )


def explode_sentences(paragraphs: DataFrame) -> DataFrame:
    """Rows (doc_id, para_idx, sent_idx, text), one per sentence."""
    return explode_items(
        paragraphs,
        ["doc_id", "para_idx"],
        splitting.sentences(F.col("text")),
        "sent_idx",
        "text",
    )


def split_into_chunks(docs: DataFrame, max_bytes: int = CHUNK_MAX_BYTES) -> DataFrame:
    """Rows (doc_id, chunk_idx, chunk, n_bytes) from (doc_id, text).

    Whole paragraphs are packed while they fit. A paragraph of max_bytes or
    more is packed by sentence on its own, and a sentence that long is cut
    between characters. The splitting and the assembly are Catalyst
    expressions; Python only decides where to cut, from the sizes, so the text
    stays in the JVM except for overlong sentences. No shuffle.
    """
    units = docs.select(
        "doc_id", units_of(splitting.paragraphs(F.col("text")), max_bytes).alias("units")
    )
    sized = units.select(
        "doc_id",
        "units",
        F.transform("units", lambda u: F.octet_length(u["text"])).alias("sizes"),
        F.transform("units", lambda u: u["run"]).alias("runs"),
        F.transform(
            "units",
            lambda u: F.when(F.octet_length(u["text"]) >= max_bytes, u["text"]),
        ).alias("overlong"),
    )
    cut = sized.select(
        "doc_id", "units", _cutter(max_bytes)("sizes", "runs", "overlong").alias("cuts")
    )
    chunks = F.transform("cuts", lambda c: assemble(F.col("units"), c))
    rows = explode_items(cut, ["doc_id"], chunks, "chunk_idx", "chunk")
    return rows.withColumn("n_bytes", F.octet_length("chunk"))


def units_of(paragraphs: Column, max_bytes: int) -> Column:
    """The smallest things to pack: paragraphs, or sentences of a long one.

    ``run`` is -1 for paragraphs, which may share a chunk, and the position of
    the paragraph for its sentences, which share chunks among themselves only.
    """

    def split(paragraph: Column, position: Column) -> Column:
        fits = F.octet_length(paragraph) < max_bytes
        return F.when(fits, F.array(_unit(paragraph, F.lit(-1)))).otherwise(
            F.transform(splitting.sentences(paragraph), lambda s: _unit(s, position))
        )

    return F.flatten(F.transform(paragraphs, split))


def _unit(text: Column, run: Column) -> Column:
    return F.struct(text.alias("text"), run.cast("int").alias("run"))


def assemble(units: Column, cut: Column) -> Column:
    members = F.transform(F.slice(units, cut["first"] + 1, cut["n"]), lambda u: u["text"])
    joined = F.when(
        F.element_at(units, cut["first"] + 1)["run"] < 0, F.array_join(members, SEPARATOR)
    ).otherwise(F.array_join(members, ""))
    return F.coalesce(cut["piece"], joined)


def _cutter(max_bytes: int):
    @F.arrow_udf(CUTS)
    def cut(sizes: pa.Array, runs: pa.Array, overlong: pa.Array) -> pa.Array:
        rows = zip(sizes.to_pylist(), runs.to_pylist(), overlong.to_pylist())
        kind = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("piece", pa.string())])
        return pa.array(
            (None if row[0] is None else pack(*row, max_bytes) for row in rows), pa.list_(kind)
        )

    return cut


def pack(
    sizes: list[int], runs: list[int], overlong: list[str | None], max_bytes: int
) -> list[tuple[int, int, str | None]]:
    """Greedy cuts (first unit, number of units, piece of an overlong unit)."""
    gaps = [len(SEPARATOR) if run < 0 else 0 for run in runs]
    ends = [0, *accumulate(size + gap for size, gap in zip(sizes, gaps))]
    run_end = len(runs)
    stops = [0] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        if runs[i] != runs[min(i + 1, len(runs) - 1)]:
            run_end = i + 1
        stops[i] = run_end
    cuts: list[tuple[int, int, str | None]] = []
    i = 0
    while i < len(sizes):
        if overlong[i] is not None:
            cuts.extend((i, 1, piece) for piece in cut_by_bytes(overlong[i], max_bytes))
            i += 1
            continue
        # the last unit of a chunk brings no separator of its own
        end = bisect_left(ends, ends[i] + gaps[i] + max_bytes, i + 1, stops[i] + 1) - 1
        cuts.append((i, end - i, None))
        i = end
    return cuts
