"""Audit of sources: how far the words of each (lang, source) lie from those of other sources of the language.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z in lower case. They are counted in
packed form. A term of up to 8 bytes is one big-endian word of 64 bits, one of up to 16 bytes two; no
term holds a zero byte, so padding with zeros is reversible and the order of the words is that of the bytes. The words of a
piece of texts are radix-sorted by digits of 16 bits and equal ones counted as runs; the sort is stable, so within a run
the documents stand in order and are counted too. Longer terms go to buckets by their length, up to the next power
of two, which are sorted as byte strings. Sorted runs of several pieces are merged in the same way.

Spark shuffles the runs by (lang, term), partially summed by task, and keeps the terms that ``min_docs`` documents of
the language hold. With V such terms in the language, a group whose counts over them sum to N gives each
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two values are (p - q)^2 / (p + q) apart, rounded down. Divisions
are of integers of up to 38 digits, so counts of any size are exact.

Pairs of sources are the result asked for, so their number is quadratic in the sources of a language. They are
summed in cells: sources are dealt into blocks of about ``BLOCK`` by hash, terms into parts of about
``CELL_ROWS`` rows, and a cell holds two blocks and one part. Terms that neither block holds add the same to
each pair and are multiplied.

What moves: each different (lang, source, term) of a task once; the kept ones again, once for every block of sources.

Defined results: null text, lang and source count as empty ones; every row counts as a document, also where
ids repeat; a group without kept terms gives values by N = 0, and 0 where its language has none; a source alone in its
language has no pairs; no documents give no rows. Only ``text``, ``lang`` and ``source`` are read, so further
columns and their names do not matter. A piece holds whole texts, at least one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castlist.llm.common import LOWER, UPPER
from castlist.session import cut_lineage

ONE = 1_000_000_000
PIECE_BYTES = 4_000_000
MOST_RUNS = 1_000_000
MOST_LONG_BYTES = 16_000_000
BLOCK = 256
CELL_ROWS = 400_000
CHUNK = 2048

# Every byte of a term as it is counted, zero for all others.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[list(LOWER.encode())] = _FOLD[list(UPPER.encode())] = list(LOWER.encode())
# The first k of eight bytes.
_FIRST = np.array([0] + [(1 << 64) - (1 << 8 * (8 - k)) for k in range(1, 9)], np.uint64)

KEY = ["w0", "w1", "tail"]


# ---- Counting inside a task --------------------------------------------------------------


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows by unsigned words, the first of them most significant."""
    order = None
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> shift).astype(np.uint16)
            if digit.size == 0 or (digit == digit[0]).all():
                continue
            # numpy sorts 16-bit integers stably by counting.
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)


def _counted(rows: np.ndarray, groups: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first rows of runs, occurrences, documents) of sorted words, the rows of equal words in order."""
    starts = np.flatnonzero(_run_starts(groups, *words))
    documents = _run_starts(rows, *words).astype(np.int64)
    return starts, np.diff(np.append(starts, len(rows))), _sums(documents, starts)


class Runs:
    """Counts of packed terms by group, merged whenever they are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.long: dict[tuple[int, bytes], list[int]] = defaultdict(lambda: [0, 0])
        self.long_bytes = 0

    def add(self, texts: list[bytes], groups: np.ndarray) -> None:
        """Count the texts; ``groups`` are their groups, in ascending order."""
        data = _FOLD[np.frombuffer(b"\0" + b"\0".join(texts) + bytes(17), np.uint8)]
        inside = data != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        ends = np.cumsum([len(text) + 1 for text in texts])
        rows = np.searchsorted(ends, starts, side="right")
        owners = groups[rows]
        eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        load = lambda at, n: eight[at].astype(np.uint64) & _FIRST[np.clip(n, 0, 8)]
        for low, high in ((1, 8), (9, 16)):
            chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
            at, n = starts[chosen], lengths[chosen]
            words = [load(at, n)] if high == 8 else [load(at, n), load(at + 8, n - 8)]
            order = radix_order(*words)
            words, chosen = [w[order] for w in words], chosen[order]
            first, uses, docs = _counted(rows[chosen], owners[chosen], *words)
            second = words[1][first] if high == 16 else np.zeros(len(first), np.uint64)
            self._append(owners[chosen][first], words[0][first], second, uses, docs)
        self._add_long(data, starts, lengths, rows, owners)

    def _append(self, *run: np.ndarray) -> None:
        self.parts.append(run)
        self.size += len(run[0])

    def merge(self) -> None:
        if len(self.parts) > 1:
            groups, w0, w1, uses, docs = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = radix_order(groups, w0, w1)
            groups, w0, w1 = groups[order], w0[order], w1[order]
            first = np.flatnonzero(_run_starts(groups, w0, w1))
            sums = (_sums(c[order], first) for c in (uses, docs))
            self.parts = [(groups[first], w0[first], w1[first], *sums)]
        self.size = sum(len(part[0]) for part in self.parts)

    def _add_long(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, owners: np.ndarray) -> None:
        chosen = np.flatnonzero(lengths > 16)
        widths = np.ceil(np.log2(np.maximum(lengths[chosen], 1))).astype(np.int64)
        for width in np.unique(widths):
            bucket = chosen[widths == width]
            terms = np.array([data[starts[i] : starts[i] + lengths[i]].tobytes() for i in bucket])
            order = np.argsort(terms, kind="stable")
            terms, bucket = terms[order], bucket[order]
            for i, uses, docs in zip(*_counted(rows[bucket], owners[bucket], terms), strict=True):
                key = (int(owners[bucket[i]]), bytes(terms[i]))
                if key not in self.long:
                    self.long_bytes += len(key[1]) + 200
                held = self.long[key]
                held[0] += int(uses)
                held[1] += int(docs)

    def batches(self, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Everything counted, with the groups' names; nothing is held afterwards."""
        self.merge()
        langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in range(2))
        if self.size:
            groups, w0, w1, uses, docs = self.parts[0]
            for k in range(0, len(groups), 100_000):
                cut = slice(k, k + 100_000)
                g, words = pa.array(groups[cut]), [pa.array(w[cut].view(np.int64)) for w in (w0, w1)]
                tails = pa.nulls(len(g), pa.binary())
                columns = [langs.take(g), sources.take(g), *words, tails, pa.array(uses[cut]), pa.array(docs[cut])]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)
        if self.long:
            g = pa.array([group for group, _ in self.long], pa.int64())
            tails = pa.array([term for _, term in self.long], pa.binary())
            zeros = pa.array(np.zeros(len(g), np.int64))
            counts = [pa.array([held[i] for held in self.long.values()], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), zeros, zeros, tails, *counts], _NAMES)
        self.__init__()


_NAMES = ["lang", "source", *KEY, "n", "docs"]
_COUNTS = "lang string, source string, w0 long, w1 long, tail binary, n long, docs long"


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of about PIECE_BYTES in all, at least one."""
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > PIECE_BYTES:
            yield slice(first, i)
            first, held = i, 0
        held += size + 1
    if first < len(sizes):
        yield slice(first, len(sizes))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[str, str], int] = {}
    runs = Runs()
    for batch in batches:
        names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        owners = np.array([numbers.setdefault(name, len(numbers)) for name in names], np.uint32)
        for piece in _pieces(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)):
            order = np.argsort(owners[piece], kind="stable")
            texts = batch.column(0).slice(piece.start, piece.stop - piece.start).cast(pa.binary()).to_pylist()
            runs.add([texts[i] for i in order], owners[piece][order])
            if runs.size > MOST_RUNS:
                runs.merge()
            if runs.size > MOST_RUNS // 2 or runs.long_bytes > MOST_LONG_BYTES:
                yield from runs.batches(list(numbers))
    yield from runs.batches(list(numbers))


# ---- The corpus -------------------------------------------------------------------------


def unpacked() -> Column:
    """The term that w0, w1 and tail stand for."""
    packed = F.concat(*(F.lpad(F.hex(w), 16, "0") for w in KEY[:2]))
    short = F.regexp_replace(packed, "(00)+$", "")
    return F.coalesce(F.col("tail"), F.unhex(short)).cast("string")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, item, n, lang_n, one): counts of the terms that ``min_docs`` documents of a language hold.

    ``one`` is 1 in a single row of each (lang, item) and 0 in the others.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    partial = texts.mapInArrow(_count_batches, _COUNTS).repartition("lang", *KEY)
    counts = partial.groupBy("lang", "source", *KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # Both windows have the partitioning the rows already have.
    term = Window.partitionBy("lang", *KEY)
    placed = counts.select(
        "*",
        F.sum("docs").over(term).alias("lang_docs"),
        F.sum("n").over(term).alias("lang_n"),
        F.row_number().over(term.orderBy("source")).alias("place"),
    ).where(F.col("lang_docs") >= min_docs)
    one = F.when(F.col("place") == 1, 1).otherwise(0).cast("long").alias("one")
    return placed.select("lang", "source", unpacked().alias("item"), "n", "lang_n", one)


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), by decimals; 1 where there are no kinds."""
    above = F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = F.when(kinds > 0, total + 2 * kinds).otherwise(F.lit(1)).cast("decimal(20,0)")
    return F.when(kinds > 0, _div(above, below) + 1).otherwise(F.lit(1)).cast("long")


def _div(above: Column, below: Column) -> Column:
    return F.call_function("div", above, below)


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kinds, zero, blocks) of every group that occurs.

    ``zero`` is what a term without occurrences gets, ``blocks`` into how many blocks the sources of the language are dealt.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(blank("lang"), blank("source")).distinct()
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    langs = kept.groupBy("lang").agg(F.sum("one").alias("kinds"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    joined = groups.join(sizes, "lang").join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    filled = joined.na.fill(0, ["total", "lang_total", "kinds"])
    return filled.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")))


def _sum_cell(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of a cell for its pairs of sources, the first before the second."""
    sources, zero = groups.column("source").to_pylist(), groups.column("zero").to_numpy()
    low, high, here = (groups.column(c).to_numpy() for c in ("low", "high", "home"))
    number = {source: i for i, source in enumerate(sources)}
    codes = terms.column("item").combine_chunks().dictionary_encode().indices.to_numpy()
    rows = np.array([number[s] for s in terms.column("source").to_pylist()], np.int64)
    order = np.argsort(codes, kind="stable")
    codes, rows, values = codes[order], rows[order], terms.column("p").to_numpy()[order]
    seen = int(codes[-1]) + 1 if len(codes) else 0
    sums = np.zeros((len(sources), len(sources)), np.int64)
    for first in range(0, seen, CHUNK):
        cut = slice(*np.searchsorted(codes, (first, first + CHUNK)))
        table = np.repeat(zero[:, None], min(CHUNK, seen - first), axis=1)
        table[rows[cut], codes[cut] - first] = values[cut]
        for i in range(len(sources)):
            others = table[i + 1 :]
            difference = others - table[i]
            sums[i, i + 1 :] += (difference * difference // (others + table[i])).sum(axis=1)
    # A cell of one block has the pairs inside it, a cell of two those across.
    one_block = len(low) > 0 and low[0] == high[0]
    i, j = np.triu_indices(len(sources), 1)
    wanted = np.full(len(i), one_block) | (here[i] != here[j])
    i, j = i[wanted], j[wanted]
    difference = zero[i] - zero[j]
    names = pa.array(sources, pa.string())
    return pa.table(
        {
            "lang": groups.column("lang").combine_chunks().take(pa.array(np.zeros(len(i), np.int64))),
            "a": names.take(pa.array(i)),
            "b": names.take(pa.array(j)),
            "value": pa.array(sums[i, j]),
            "seen": pa.array(np.full(len(i), seen, np.int64)),
            "unseen": pa.array(difference * difference // (zero[i] + zero[j])),
        }
    )


def pair_values(entries: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """(lang, source, item, value): the summed distance of every two sources of a language, both ways round.

    ``entries`` are (lang, source, item, p, blocks) of the terms that a group has, ``groups`` as of ``group_totals``.
    """
    home = F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def placed(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("home", home).withColumn("other", other)
        return dealt.withColumns({"low": F.least("home", "other"), "high": F.greatest("home", "other")})

    cell = ["lang", "low", "high", "part"]
    part = F.pmod(F.xxhash64("item"), F.lit(parts).cast("long")).cast("int").alias("part")
    terms = placed(entries).select("lang", "low", "high", part, "source", "item", "p")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    owners = placed(groups).select("lang", "low", "high", every, "source", "zero", "home")
    schema = "lang string, a string, b string, value long, seen long, unseen long"
    cells = terms.groupBy(*cell).cogroup(owners.groupBy(*cell)).applyInArrow(_sum_cell, schema)
    sums = cells.groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("unseen").alias("unseen")
    )
    kinds = groups.groupBy("lang").agg(F.first("kinds").alias("kinds"))
    whole = sums.join(kinds, "lang").withColumn("value", F.expr("value + (kinds - seen) * unseen"))
    both = F.expr("array(struct(a AS source, b AS item), struct(b AS source, a AS item))")
    return whole.select("lang", F.inline(both), "value")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    Part ``pair``: every other source of the language with the distance to it. Part ``term``: the ``top`` terms that the
    source uses more than its language does, with what each adds to the distance from the language.
    """
    kept = cut_lineage(kept_terms(docs, min_docs))
    groups = cut_lineage(group_totals(docs, kept))
    entries = kept.join(groups, ["lang", "source"])
    entries = entries.withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
    parts = kept.count() // CELL_ROWS + 1
    pairs = pair_values(entries.select("lang", "source", "item", "p", "blocks"), groups, parts)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    own = entries.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))).where("p > q")
    own = own.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
    # Spark cuts the rows of each task to the first places before it exchanges them.
    best = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return ranked.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
