"""Chunking of texts longer than a cell: greedy packing from any entry point, segments linked by what is open between them.

A segment of whole paragraphs is packed as in ``castlist.operators.chunks``, except that its first paragraphs may still go to the
chunk that is open before it. How many do depends on that chunk's bytes alone, so these are the state, 0 if
none is open. From each unit at which a new chunk may start a jump pointer leads to the unit after that chunk; followed backwards
they give, for every entry point, the number of chunks and the bytes open at the end. These are the summary
of the segment. Only the chunks at a cut are put together from several segments.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.functions import splitting
from castlist.functions.splitting import cut_by_bytes
from castlist.operators import segments
from castlist.operators.chunks import CHUNK_MAX_BYTES, SEPARATOR, assemble, pack, units_of
from castlist.operators.rows import inline_structs
from castlist.session import cut_lineage

GAP = len(SEPARATOR)
CUTS = "array<struct<first:int,n:int,piece:string,chunk_idx:long,joint:boolean>>"


def _entries(sizes: list[int], runs: list[int], max_bytes: int) -> list[int]:
    """What the first 0, 1, 2, .. paragraphs add to an open chunk, for as many as may fit one."""
    added = [0]
    for size, run in zip(sizes, runs):
        if run >= 0 or added[-1] + GAP + size + 1 >= max_bytes:
            break
        added.append(added[-1] + GAP + size)
    return added


def summary(sizes: list[int], runs: list[int], overlong: list[str | None], max_bytes: int) -> list[int]:
    """[number of units, entry points, what the units before each add, chunks from each, open bytes at the end from each]."""
    n = len(sizes)
    added = _entries(sizes, runs, max_bytes)
    gaps = [GAP if run < 0 else 0 for run in runs]
    ends = [0, *accumulate(size + gap for size, gap in zip(sizes, gaps))]
    chunks, left = [0] * (n + 1), [0] * (n + 1)
    stop = n
    for i in range(n - 1, -1, -1):
        if i + 1 < n and runs[i] != runs[i + 1]:
            stop = i + 1
        if overlong[i] is not None:
            chunks[i], left[i] = chunks[i + 1] + len(cut_by_bytes(overlong[i], max_bytes)), left[i + 1]
            continue
        after = bisect_left(ends, ends[i] + gaps[i] + max_bytes, i + 1, stop + 1) - 1
        chunks[i] = chunks[after] + 1
        open_ = after == n and runs[i] < 0
        left[i] = ends[n] - ends[i] - GAP if open_ else left[after]
    k = len(added)
    return [n, k, *added, *chunks[:k], *left[:k]]


def _entry(state: int, added: list[int], max_bytes: int) -> int:
    """How many of the first units go to the open chunk."""
    return bisect_right(added, max_bytes - 1 - state) - 1 if state else 0


def follow(max_bytes: int) -> segments.Follow:
    def after(state: int, numbers: list[int]) -> tuple[int, int]:
        n, k = numbers[:2]
        added, chunks, left = (numbers[2 + k * j : 2 + k * (j + 1)] for j in range(3))
        at = _entry(state, added, max_bytes)
        return (state + added[at], 0) if at == n else (left[at], chunks[at])

    return after


def pack_segment(
    sizes: list[int], runs: list[int], overlong: list[str | None], state: int, before: int, max_bytes: int
) -> list[dict]:
    """The cuts of a segment, with their chunk numbers and whether other segments may have parts of the chunk."""
    at = _entry(state, _entries(sizes, runs, max_bytes), max_bytes)
    cuts = [(0, at, None)] if at else []
    number = before - 1 if at else before
    cuts += [(first + at, n, piece) for first, n, piece in pack(sizes[at:], runs[at:], overlong[at:], max_bytes)]
    rows = []
    for k, (first, n, piece) in enumerate(cuts):
        last = k == len(cuts) - 1 and piece is None and runs[first] < 0
        joint = last or (k == 0 and at > 0)
        rows.append({"first": first, "n": n, "piece": piece, "chunk_idx": number + k, "joint": joint})
    return rows


def chunk_segments(rows: DataFrame, max_bytes: int = CHUNK_MAX_BYTES) -> DataFrame:
    """Rows (doc_id, chunk_idx, chunk, n_bytes) from (doc_id, seg_idx, text): the chunks of the joined segments."""
    whole = segments.whole_paragraphs(rows)
    # Stored, since the summaries and the cuts are both made from them, as are the whole and the joint chunks from the pieces.
    units = cut_lineage(whole.select("doc_id", "seg_idx", units_of(splitting.paragraphs(F.col("text")), max_bytes).alias("units")))
    sized = units.select(
        "doc_id",
        "seg_idx",
        "units",
        F.transform("units", lambda u: F.octet_length(u["text"])).alias("sizes"),
        F.transform("units", lambda u: u["run"]).alias("runs"),
        F.transform("units", lambda u: F.when(F.octet_length(u["text"]) >= max_bytes, u["text"])).alias("overlong"),
    )

    @F.arrow_udf("array<int>")
    def summarised(*columns: pa.Array) -> pa.Array:
        given = zip(*(c.to_pylist() for c in columns))
        return pa.array([summary(*row, max_bytes) for row in given], pa.list_(pa.int32()))

    @F.arrow_udf(CUTS)
    def cut(*columns: pa.Array) -> pa.Array:
        given = zip(*(c.to_pylist() for c in columns))
        kinds = [("first", pa.int32()), ("n", pa.int32()), ("piece", pa.string()), ("chunk_idx", pa.int64()), ("joint", pa.bool_())]
        return pa.array([pack_segment(*row, max_bytes) for row in given], pa.list_(pa.struct(kinds)))

    facts = ("sizes", "runs", "overlong")
    states = segments.start_states(
        sized.select("doc_id", "seg_idx", summarised(*facts).alias("summary")), 0, follow(max_bytes)
    )
    placed = segments.with_states(sized, states)
    made = placed.select("doc_id", "seg_idx", "units", cut(*facts, "state", "before").alias("cuts"))
    parts = F.transform(
        "cuts",
        lambda c: F.struct(c["chunk_idx"].cast("int").alias("chunk_idx"), assemble(F.col("units"), c).alias("chunk"), c["joint"].alias("joint")),
    )
    pieces = cut_lineage(inline_structs(made, ["doc_id", "seg_idx"], parts, "chunk_idx"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "chunk")))
    joints = pieces.where("joint").groupBy("doc_id", "chunk_idx").agg(ordered.alias("parts"))
    joints = joints.select("doc_id", "chunk_idx", F.array_join(F.transform("parts", lambda p: p["chunk"]), SEPARATOR).alias("chunk"))
    chunks = pieces.where("NOT joint").select("doc_id", "chunk_idx", "chunk").unionByName(joints)
    return chunks.withColumn("n_bytes", F.octet_length("chunk"))
