"""Ranked search of all documents for every item, by scanning the texts with an automaton of the items' terms.

Terms are maximal runs of digits, ASCII letters and characters beyond ASCII, A-Z in lower case. Every other byte of a
text becomes a space, and every pattern of the automaton is a term between two spaces, so that it matches whole terms only;
neighbouring matches share a space. The texts are scanned twice and nothing about them is stored: the first scan counts
the documents of each term (df) and all terms, the second has a document's tf from the matches, maps the terms to
the items that hold them, and adds up each item's score.

With N documents that have a term, L terms in all and n in a document, a term weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))), m is 50 + floor(50 n N / L), and a document's score for an item is the sum of
w * floor(10^9 tf / (1000 tf + 20 m)) over the item's different terms.

Items are dealt by hash into blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of terms, measured first. A block is
broadcast and its two scans are made; the driver holds one block at a time. Every task keeps its ``top`` documents
of each item, dropping those that so many others surpass, and Spark ranks what the tasks kept. Items do not meet
across blocks, so the result is the same however many there are.

Defined results: null texts have no terms, and are in no result; an item without terms, or whose terms occur
nowhere, has no rows. Equal scores rank by ``doc_id``, nulls last; each row of documents and of items counts by itself, also
where ids repeat. ``doc_id`` and ``item_id`` may have any type that can be ordered. Only the columns (doc_id, text) and
(item_id, text) are read. Texts are scanned in pieces that end at a space.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castlist.llm.common import LOWER, UPPER, lowered
from castlist.session import cut_lineage

# Fixed value: the terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK_ITEMS = 4096
BLOCK_BYTES = 4_000_000
PIECE = 4_000_000
CELLS = 1_000_000

_PLAIN = bytearray(b" " * 0x80 + bytes(range(0x80, 0x100)))
for _c in b"0123456789" + LOWER.encode():
    _PLAIN[_c] = _c
for _c, _l in zip(UPPER.encode(), LOWER.encode(), strict=True):
    _PLAIN[_c] = _l
_PLAIN = bytes(_PLAIN)


def plain(text: bytes) -> bytes:
    """A text with its terms in lower case and a space for every other byte, and spaces at both ends."""
    return b" " + text.translate(_PLAIN) + b" "


def pieces(line: bytes) -> Iterator[bytes]:
    """A plain text in pieces that overlap by a space."""
    at = 0
    while at < len(line) - 1:
        end = line.find(b" ", min(at + PIECE, len(line) - 1))
        yield line[at : end + 1]
        at = end


def n_terms(line: bytes) -> int:
    space = np.frombuffer(line, np.uint8) == 0x20
    return int(np.count_nonzero(space[:-1] & ~space[1:]))


@dataclass
class Block:
    """Some items: their different terms, and the items of term k from ``bounds[k]`` to ``bounds[k + 1]`` of ``holders``."""

    items: np.ndarray
    terms: list[str]
    bounds: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, list[str]]]) -> Block:
        """From the number and the different terms of each item."""
        held: dict[str, list[int]] = {}
        for i, (_, terms) in enumerate(items):
            for term in terms:
                held.setdefault(term, []).append(i)
        bounds = np.cumsum([0] + [len(h) for h in held.values()])
        holders = np.array([i for h in held.values() for i in h], np.int64)
        return Block(np.array([number for number, _ in items], np.int64), list(held), bounds, holders)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once in each worker; bytes stand for themselves as Latin-1."""
        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(f" {term.encode().decode('latin-1')} ", k)
        found.make_automaton()
        return found

    def counts(self, line: bytes) -> Counter[int]:
        """How often each term stands in a plain text."""
        found: Counter[int] = Counter()
        for piece in pieces(line):
            found.update(map(itemgetter(1), self.automaton.iter(piece.decode("latin-1"))))
        return found


def document_counts(docs: DataFrame, shared: Broadcast) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents of each term of the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        held = np.zeros(len(block.terms), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(0):
                line = plain((text.as_py() or "").encode())
                n = n_terms(line)
                documents, total = documents + (n > 0), total + n
                held[list(block.counts(line))] += 1
        found = np.flatnonzero(held)
        keys, values = np.append(found, (-1, -2)), np.append(held[found], (documents, total))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = np.zeros(len(shared.value.terms), np.int64)
    totals = {-1: 0, -2: 0}
    for row in sums.collect():
        if row.term < 0:
            totals[row.term] = row.n
        else:
            held[row.term] = row.n
    return totals[-1], totals[-2], held


_BEST = "item long, score long, doc_id {}"


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


class Best:
    """The highest-scoring documents of every item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)
        self.tables: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores by document and item."""
        rows, items = np.nonzero(scores >= self.least)
        if len(rows):
            columns = [pa.array(items), pa.array(scores[rows, items]), ids.take(pa.array(rows))]
            self.tables.append(pa.table(columns, ["item", "score", "doc_id"]))
            self.size += len(rows)
            if self.size > 4 * self.top * len(self.least) + CELLS // 4:
                self.prune()

    def prune(self) -> pa.Table | None:
        """Drop what ``top`` documents surpass; those that tie with the last place by a smaller id stay."""
        if not self.tables:
            return None
        held = pa.concat_tables(self.tables).combine_chunks()
        order = pc.sort_indices(
            held, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"
        )
        held = held.take(order)
        items = held.column("item").to_numpy()
        place = np.arange(len(items)) - np.searchsorted(items, items)
        last = place == self.top - 1
        self.least[items[last]] = held.column("score").to_numpy()[last]
        held = held.filter(pa.array(place < self.top))
        self.tables, self.size = [held], len(held)
        return held


def score_rows(block: Block, weight: np.ndarray, n_docs: int, total: int, texts: pa.Array) -> np.ndarray:
    """Scores by text and item."""
    owners, terms, uses, scale = [], [], [], []
    for row, text in enumerate(texts):
        line = plain((text.as_py() or "").encode())
        found = block.counts(line)
        if found:
            owners.append(np.full(len(found), row))
            terms.append(np.fromiter(found.keys(), np.int64, len(found)))
            uses.append(np.fromiter(found.values(), np.int64, len(found)))
            scale.append(np.full(len(found), 20 * (50 + 50 * n_terms(line) * n_docs // total)))
    scores = np.zeros(len(texts) * len(block.items), np.int64)
    if owners:
        owner, term, tf, m = (np.concatenate(c) for c in (owners, terms, uses, scale))
        gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + m))
        first, size = block.bounds[term], np.diff(block.bounds)[term]
        # The places of all holders of each term, one after another.
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        np.add.at(scores, np.repeat(owner * len(block.items), size) + block.holders[places], np.repeat(gain, size))
    return scores.reshape(len(texts), len(block.items))


def best_documents(docs: DataFrame, shared: Broadcast, weight: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """(item, score, doc_id): what each task finds best for the items of a block; nothing if there are no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(len(block.items), top)
        step = max(1, CELLS // len(block.items))
        for batch in batches:
            for k in range(0, len(batch), step):
                texts = batch.column(1).slice(k, step)
                best.add(score_rows(block, weight, n_docs, total, texts), batch.column(0).slice(k, step))
        held = best.prune()
        if held is not None:
            held = held.set_column(0, "item", pa.array(block.items).take(held.column("item")))
            yield from held.to_batches(max_chunksize=10_000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, _BEST.format(kind))


def search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) with the highest score above 0 of each item."""
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    split = items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms"))
    stored = cut_lineage(split.where(F.size("terms") > 0))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    n_items, n_bytes = stored.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-n_bytes // BLOCK_BYTES))
    found = spark.createDataFrame([], _BEST.format(docs.schema["doc_id"].dataType.simpleString()))
    for k in range(blocks):
        rows = stored.where(F.pmod(F.xxhash64("item"), F.lit(blocks).cast("long")) == k).select("item", "terms").collect()
        if rows:
            shared = spark.sparkContext.broadcast(Block.of([(row.item, row.terms) for row in rows]))
            n_docs, total, held = document_counts(docs, shared)
            found = found.unionByName(best_documents(docs, shared, weights(n_docs, held), n_docs, total, top))
    # Spark cuts the rows of each task to the first places before it exchanges them.
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(stored.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
