"""Counting one list of names in all documents: the form for a list that does not belong to a document.

No list of names travels with a document, and documents do not meet names in a join. The distinct names are dealt by
hash into blocks of about ``BLOCK_BYTES``, which are measured first. A block is broadcast; every worker builds one
automaton of it and runs all its texts through that, whatever the number of names. Each block is a scan of the texts.

Counts are those of ``castlist.operators.names``: every name by itself, its occurrences from left to right without
overlap, also inside other names. An automaton finds overlapping occurrences too, so for names that can overlap themselves
(``anan``) the end of the last counted one is remembered. Long texts are run through in pieces that
overlap by one character less than the longest name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.functions.text import strip
from castlist.session import cut_lineage

BLOCK_BYTES = 4_000_000
PIECE = 4_000_000
ROWS = 50_000


def overlaps_itself(name: str) -> bool:
    """True if an end of the name is also its beginning."""
    borders = [0] * len(name)
    k = 0
    for i in range(1, len(name)):
        while k and name[i] != name[k]:
            k = borders[k - 1]
        k += name[i] == name[k]
        borders[i] = k
    return bool(name) and borders[-1] > 0


@dataclass
class Block:
    """Names, none empty and all different."""

    names: list[str]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once in each worker, for as long as it keeps the broadcast."""
        found = ahocorasick.Automaton()
        for k, name in enumerate(self.names):
            found.add_word(name, k)
        found.make_automaton()
        return found

    @cached_property
    def overlapping(self) -> frozenset[int]:
        return frozenset(k for k, name in enumerate(self.names) if overlaps_itself(name))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.names))

    def _found(self, text: str) -> Iterator[tuple[int, int]]:
        """(last character, name) of every occurrence, by its end."""
        step = max(PIECE, 2 * self.longest)
        for start in range(0, max(1, len(text)), step):
            before = min(start, self.longest - 1)
            for end, k in self.automaton.iter(text[start - before : start + step]):
                if end >= before:
                    yield end + start - before, k

    def counts(self, text: str) -> Counter[int]:
        """How often each name occurs in the text; names that do not are missing."""
        if not self.overlapping and len(text) <= PIECE:
            return Counter(map(itemgetter(1), self.automaton.iter(text)))
        total: Counter[int] = Counter()
        free_from: dict[int, int] = {}
        for end, k in self._found(text):
            if k in self.overlapping:
                if end - len(self.names[k]) + 1 < free_from.get(k, 0):
                    continue
                free_from[k] = end + 1
            total[k] += 1
        return total


def name_blocks(names: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The different stripped names in blocks, each collected by itself."""
    listed = names.select(strip(F.col("name")).alias("name")).where(F.col("name") != "").distinct()
    stored = cut_lineage(listed)
    size = stored.agg(F.sum(F.octet_length("name").cast("bigint"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        mine = stored.where(F.pmod(F.xxhash64("name"), F.lit(blocks).cast("bigint")) == k)
        if rows := mine.collect():
            yield [row.name for row in rows]


def count_listed(docs: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, name, occurrences) of the documents (doc_id, text) for rows (name): those with occurrences.

    Names are stripped; empty and missing ones are dropped and repeated ones counted once. Every pair that has no
    row occurs 0 times. A missing text has no names.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, name string, occurrences int"
    found = spark.createDataFrame([], schema)
    for block in name_blocks(names, block_bytes):
        shared = spark.sparkContext.broadcast(Block(block))
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(_counter(shared), schema))
    return found


def _counter(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, names, counts = [], [], []

            def made(owners: list, names: list, counts: list, ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                columns = [ids.take(pa.array(owners, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "occurrences"])

            for row, text in enumerate(batch.column(1)):
                found = shared.value.counts(text.as_py() or "")
                owners += [row] * len(found)
                names += [shared.value.names[k] for k in found]
                counts += found.values()
                if len(owners) >= ROWS:
                    yield made(owners, names, counts)
                    owners, names, counts = [], [], []
            yield made(owners, names, counts)

    return run


def listed_totals(counts: DataFrame) -> DataFrame:
    """Rows (name, n_docs, occurrences) of the names that occur at all, most frequent names summed by task first."""
    return counts.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("occurrences").cast("bigint").alias("occurrences")
    )
