"""Benchmark decontamination with suffix arrays of the training texts.

The documents of a task are taken in shards. The words of a shard, as numbers, form one
sequence with a break after every document, and its suffix array holds the
positions in the order of the next words, ``DEPTH`` of them, with which a comparison ends. Every suffix
of the benchmark that can begin a forbidden window is searched in each shard by bisection, all
of them at once; the bounds of its range are where its window occurs. Occurrences that follow each other in both texts are
one match, so the matches are the longest verbatim ones, each with its place in the item and in the document.
What is reported and removed follows from them.

The words of the benchmark are numbered; every other word is a break, since no match
runs across it, and suffixes that start at a break are left out of the arrays. Words are found
by a 64-bit hash, and every word of a match is compared with the item byte by byte before it
counts.

Documents are not shuffled: each is judged where it was read, by itself. Items of one text are one, with all their
ids. Tasks write the benchmark into files of about ``BLOCK_BYTES`` in the shared folder, and the tasks that judge read them one by one for
each shard, so the benchmark is nowhere held as a whole and the answer is the same however many blocks it has.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become a-z. A window is ``window``
consecutive words of an item; an item of fewer, but not none, is one window. A null text
has no words. Repeated items and documents each count, ids may be null, repeated and of any type. Empty tables give no
matches. Further columns of the documents are kept, whatever their names. An item with over two million different words
raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from castlist.session import new_table
from castlist.sources import shared

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
# How many words one sort key packs, and how many keys order a suffix.
PACK, KEYS = 3, 4
DEPTH = PACK * KEYS
WIDTH = 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IN_WORD[_low : _high + 1] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of texts joined by NUL: the folded bytes, bounds, hashes, and words before each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[bytes]) -> Words:
    """All words of the texts, in order; no word crosses the end of a text."""
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    data = _FOLD[joined]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


class Benchmark:
    """A block of different texts: their words as numbers from 1, and the suffixes to search."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        if window > DEPTH:
            raise ValueError(f"a window has at most {DEPTH} words")
        words = words_of([text.encode() for text in texts])
        self.vocabulary = np.unique(words.hashes)
        if len(self.vocabulary) + 2 >= 1 << WIDTH:
            raise ValueError("too many different words in a block")
        self.words = [
            bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)
        ]
        numbers = np.searchsorted(self.vocabulary, words.hashes) + 1
        sizes = np.diff(words.firsts)
        self.first_word = words.firsts[:-1]
        # How many words a window of each text has, and where all windows begin.
        self.needs = np.minimum(sizes, window)
        windows = np.where(sizes > 0, sizes - self.needs + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), windows)
        self.at = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows - self.first_word, windows)
        padded = np.concatenate((numbers, np.zeros(DEPTH, np.int64)))
        used = np.arange(DEPTH) < self.needs[self.owner][:, None]
        values = padded[self.at[:, None] + np.arange(DEPTH)]
        self.lower = _packed(np.where(used, values, 0))
        self.upper = _packed(np.where(used, values, (1 << WIDTH) - 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word of the benchmark's, 0 for any other."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)


def _packed(values: np.ndarray) -> np.ndarray:
    """Rows of DEPTH numbers as KEYS sort keys each."""
    grouped = values.reshape(-1, KEYS, PACK).astype(np.uint64)
    shifts = np.uint64(WIDTH) * np.arange(PACK - 1, -1, -1, dtype=np.uint64)
    return (grouped << shifts).sum(axis=2, dtype=np.uint64)


class SuffixArray:
    """The suffixes of a sequence of numbers that start at a number above 0, in order.

    The order is that of the first DEPTH numbers; a 0 ends a suffix.
    """

    def __init__(self, numbers: np.ndarray):
        padded = np.concatenate((numbers, np.zeros(DEPTH, numbers.dtype))).astype(np.uint64)
        n = len(numbers)
        three = np.zeros(n + DEPTH, np.uint64)
        length = n + DEPTH - PACK + 1
        for i in range(PACK):
            three[:length] |= padded[i : i + length] << np.uint64(WIDTH * (PACK - 1 - i))
        starts = np.flatnonzero(numbers)
        self.keys = [three[starts + PACK * k] for k in range(KEYS)]
        order = np.lexsort(self.keys[::-1])
        self.positions = starts[order]
        self.keys = [key[order] for key in self.keys]

    def bisect(self, wanted: np.ndarray, right: bool) -> np.ndarray:
        """Where each row of sort keys belongs, before or after equal suffixes."""
        low = np.zeros(len(wanted), np.int64)
        high = np.full(len(wanted), len(self.positions), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            probe = np.where(open_, middle, 0)
            less = np.full(len(wanted), right)
            for k in range(KEYS - 1, -1, -1):
                key, want = self.keys[k][probe], wanted[:, k]
                less = np.where(key == want, less, key < want)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low


@dataclass
class Matches:
    """The longest matches in a shard: which item and text, the first word in each, and how many words."""

    item: np.ndarray
    item_word: np.ndarray
    text: np.ndarray
    word: np.ndarray
    length: np.ndarray


def search(words: Words, bench: Benchmark) -> Matches:
    """All verified matches of at least a window between the benchmark and the texts of a shard."""
    numbers = bench.numbers(words.hashes)
    # A break between texts, so that nothing matches across them.
    n_texts = len(words.firsts) - 1
    owner = np.repeat(np.arange(n_texts), np.diff(words.firsts))
    spaced = np.zeros(len(numbers) + n_texts, np.int64)
    spaced[np.arange(len(numbers)) + owner] = numbers
    array = SuffixArray(spaced)
    low, high = array.bisect(bench.lower, False), array.bisect(bench.upper, True)
    counts = np.maximum(high - low, 0)
    suffix = np.repeat(np.arange(len(counts)), counts)
    ranks = np.arange(len(suffix)) - np.repeat(np.cumsum(counts) - counts, counts) + low[suffix]
    found = array.positions[ranks]
    text = np.searchsorted(words.firsts[1:] + np.arange(n_texts), found, side="right")
    item, at, word = bench.owner[suffix], bench.at[suffix], found - text
    # Windows that follow each other in both texts are one match.
    order = np.lexsort((word, word - at, item))
    item, at, text, word = item[order], at[order], text[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1])
    new[1:] |= (np.diff(word) != 1) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(word))) + bench.needs[item[first]] - 1
    rows = []
    for i, a, t, w, n in zip(*(c.tolist() for c in (item[first], at[first], text[first], word[first], length)), strict=True):
        rows += [(i, a + k, t, w + k, size) for k, size in _same(words, bench, a, w, n, int(bench.needs[i]))]
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 5
    return Matches(columns[0], columns[1] - bench.first_word[columns[0]], columns[2], columns[3] - words.firsts[columns[2]], columns[4])


def _same(words: Words, bench: Benchmark, at: int, word: int, n: int, need: int) -> Iterator[tuple[int, int]]:
    """(start, words) of the parts of a match whose bytes are equal, of those that hold a window."""
    start = 0
    for k in range(n + 1):
        if k < n and bench.words[at + k] == words.data[words.starts[word + k] : words.ends[word + k]].tobytes():
            continue
        if k - start >= need:
            yield start, k - start
        start = k + 1


def shards(texts: pa.Array, limit: int = SHARD_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts with ``limit`` bytes in all, or one longer text."""
    held, size = [], 0
    for text in texts:
        data = (text.as_py() or "").encode()
        if held and size + len(data) > limit:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


# ---- The corpus -------------------------------------------------------------------------


def store_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of the different texts of (item_id, text), each with its ids; empty texts are left out."""
    folder = new_table(items.sparkSession, "benchmark")
    texts = items.where(F.octet_length("text") > 0).groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("text"), F.lit(total // block_bytes + 1)).alias("block")

    def store(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        path = f"{folder}/{table.column('block')[0].as_py()}.arrow"
        shared.put(path, sink.getvalue().to_pybytes())
        return pa.table({"path": [path]})

    written = texts.select("text", "ids", block).groupBy("block").applyInArrow(store, "path string")
    return sorted(row.path for row in written.collect())


@lru_cache(maxsize=1)
def load_block(path: str, window: int) -> tuple[Benchmark, list[list]]:
    """The texts of a file, ready to search, and their ids; a worker keeps the last one."""
    table = pa.ipc.open_stream(shared.read(path)).read_all()
    ids = [[row["item_id"] for row in rows] for rows in table.column("ids").to_pylist()]
    return Benchmark(table.column("text").to_pylist(), window), ids


def longest_matches(text: Column, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """A struct of a text's ``n_words`` and its ``matches``, an array of (item_id, item_word, word, length).

    Each is a verbatim match of at least a window with an item that cannot be made longer, from the first word of each.
    """
    paths = store_blocks(items, block_bytes)
    one = T.StructType().add("item_id", items.schema["item_id"].dataType)
    for name in ("item_word", "word", "length"):
        one = one.add(name, "long")

    def judge(texts: pa.Array) -> pa.Array:
        sizes: list[int] = []
        rows: list[list[dict]] = []
        for shard in shards(texts):
            words = words_of(shard)
            found: list[list[dict]] = [[] for _ in shard]
            for path in paths:
                bench, ids = load_block(path, window)
                m = search(words, bench)
                for item, a, t, w, n in zip(*(c.tolist() for c in (m.item, m.item_word, m.text, m.word, m.length)), strict=True):
                    found[t] += [{"item_id": one_id, "item_word": a, "word": w, "length": n} for one_id in ids[item]]
            sizes += np.diff(words.firsts).tolist()
            rows += found
        kind = pa.list_(pa.struct([("item_id", item_type), *((name, pa.int64()) for name in ("item_word", "word", "length"))]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(rows, kind)], ["n_words", "matches"])

    item_type = to_arrow_type(items.schema["item_id"].dataType)
    result = T.StructType().add("n_words", "long").add("matches", T.ArrayType(one))
    # Declared nondeterministic so that no filter is pushed below with a copy of the call.
    return F.arrow_udf(judge, result).asNondeterministic()(text)


def n_covered(spans: Column) -> Column:
    """How many words lie in at least one of the spans (start, end)."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0).cast("long"))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document, all columns but ``text``: n_words, matches, spans, items (distinct, ascending), n_hit, longest, contaminated.

    ``spans`` are the words of the matches, ``longest`` is the length of the longest match. Columns of these names are replaced.
    """
    made = ("n_words", "matches", "spans", "items", "n_hit", "longest", "contaminated")
    kept = [c for c in docs.columns if c not in ("text", *made)]
    # The other columns travel in one, so that no name can clash.
    row = F.struct(*kept, F.lit(0).alias("_")).alias("row")
    found = docs.select(row, longest_matches(F.col("text"), items, window, block_bytes).alias("found"))
    matches = F.array_sort("found.matches")
    spans = F.transform(matches, lambda m: F.struct(m["word"].alias("start"), (m["word"] + m["length"]).alias("end")))
    return found.select(
        *(F.col("row")[c].alias(c) for c in kept),
        "found.n_words",
        matches.alias("matches"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"]))).alias("items"),
        n_covered(spans).alias("n_hit"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["length"])), F.lit(0)).cast("long").alias("longest"),
        (F.size(matches) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item; each row is judged by itself."""
    found = docs.select(F.struct(*docs.columns).alias("row"), longest_matches(F.col("text"), items, window).alias("found"))
    clean = found.where(F.size("found.matches") == 0)
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))
