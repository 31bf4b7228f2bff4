"""Removal of repeated byte strings with suffix arrays.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts in a document with
a smaller doc_id. The strings are the windows of the whole texts. Equal windows are brought together so:

* A window's anchor is the smallest hash among its grams of ``GRAM`` bytes. Equal windows have equal anchors,
  and consecutive windows mostly share theirs, so a text is a row of stretches of windows with one anchor each.
* Texts are kept in blocks of about ``BLOCK_BYTES``. Every block tells the owners of its anchors, once for
  each anchor, that it has it, and learns which are in two documents: one bit for each. Most are not, and their
  windows are done with.
* The stretches of shared anchors go to the anchors' owners, each different one once for
  a block, with the smallest doc_id. An anchor that ``CROWD`` blocks have, or that has ``CROWD_IN_BLOCK`` stretches in one, is replaced
  by the finer anchors of the windows' grams of ``FINE`` bytes, which have few different stretches each however many
  texts share a passage.
* An owner leaves out stretches none of whose windows has the hash of another's, and builds the suffix arrays of the other stretches
  of each anchor by linear grouping (``suffix_array``). Suffixes that
  share LENGTH bytes are neighbours; the smallest doc_id of such a run is the answer for its windows, and goes
  back to the blocks that asked.

So no string, however frequent, is gathered from all its documents in one place; what a task
holds is bounded by a block, or by the anchors of an owner, whose number grows with the input. Hashes
only choose who meets; windows are equal by their bytes.

Defined results: a null text is empty; matches do not cross documents; rows of one doc_id do not remove from each other; a
null doc_id counts as greater than all others; texts shorter than LENGTH stay. Tables without rows give
none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castlist.llm.suffix_array import spread, suffix_arrays
from castlist.session import cut_lineage, forget_later, new_table

LENGTH = 50
GRAM, FINE = 24, 48
BLOCK_BYTES = 2 << 20
OWNER_BYTES = 16 << 20
CROWD, CROWD_IN_BLOCK = 32, 16
STRIP = 1 << 20
BATCH_SYMBOLS = 1 << 18
LAST_ID = (1 << 63) - 1
# Spark's limit for the buckets of a table.
MOST_FILES = 100_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base; a worker keeps the longest row it has needed."""
    known = _powers_of.get(base, np.zeros(0, np.uint64))
    if len(known) < n:
        known = np.full(n, base & _MASK, np.uint64)
        known[:1] = 1
        known = _powers_of[base] = np.multiply.accumulate(known)
    return known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Stretches:
    """Runs of windows with one anchor: which text, first byte there, number of windows, anchor."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def stretches(texts: list[bytes], gram: int, owners: int) -> Stretches:
    """The stretches of all windows; an anchor is owner << 40 | 40 bits of its hash."""
    parts, at, size = [], [], 0
    found: list[tuple] = []
    for i, text in enumerate(texts):
        for s in range(0, max(len(text) - LENGTH + 1, 0), STRIP):
            part = text[s : s + STRIP + LENGTH - 1]
            parts.append(part)
            at.append((i, s))
            size += len(part)
            if size >= STRIP:
                found.append(_strip(parts, at, gram, owners))
                parts, at, size = [], [], 0
    if parts:
        found.append(_strip(parts, at, gram, owners))
    if not found:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64))
    return Stretches(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _strip(parts: list[bytes], at: list[tuple[int, int]], gram: int, owners: int) -> tuple:
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers(_BASE, n)
    np.cumsum(terms, out=sums[1:])
    grams = sums[gram:] - sums[:-gram]
    grams *= _powers(pow(_BASE, -1, 1 << 64), n - gram + 1)
    least = _mixed(grams)
    # The minimum over the grams of a window, by doubling.
    width, have = LENGTH - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    ends = begins + sizes - LENGTH + 1
    # A stretch begins where the minimum changes and at the first window of a part; windows over the end of a part are none.
    new = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=new[1 : len(least)])
    new[begins] = True
    new[spread(ends, begins + sizes - ends)] = False
    first = np.flatnonzero(new[: len(least)])
    part = np.searchsorted(begins, first, side="right") - 1
    count = np.minimum(np.append(first[1:], n), ends[part]) - first
    hashed = _mixed(least[first] + np.uint64(gram))
    anchor = (hashed % np.uint64(owners)) << np.uint64(40) | (hashed // np.uint64(owners)) & np.uint64((1 << 40) - 1)
    text = np.array([i for i, _ in at], np.int64)[part]
    start = first - begins[part] + np.array([s for _, s in at], np.int64)[part]
    return text, start, count, anchor


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each run of equal values, none of which is negative, and where it lies."""
    bounds = [*np.flatnonzero(np.diff(values, prepend=-1)).tolist(), len(values)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(values[a]), slice(a, b)


class Texts:
    """The texts of a block in a fixed order."""

    def __init__(self, table: pa.Table):
        rows = sorted(
            zip(
                (LAST_ID if i is None else i for i in table.column("doc_id").to_pylist()),
                ((t or "").encode() for t in table.column("text").to_pylist()),
                table.column("doc_id").to_pylist(),
                strict=True,
            ),
            key=lambda row: row[:2],
        )
        self.ids = np.array([row[0] for row in rows], np.int64)
        self.texts = [row[1] for row in rows]
        self.doc_ids = [row[2] for row in rows]


class Block(Texts):
    """The texts of a block and their stretches."""

    def __init__(self, table: pa.Table, owners: int):
        super().__init__(table)
        self.owners = owners
        self.runs = stretches(self.texts, GRAM, owners)
        self.anchors, self.index = np.unique(self.runs.anchor, return_inverse=True)

    def in_two_documents(self) -> np.ndarray:
        """For each different anchor, whether two doc_ids of the block have it."""
        ids = self.ids[self.runs.text]
        low = np.full(len(self.anchors), LAST_ID, np.int64)
        high = np.full(len(self.anchors), -LAST_ID - 1, np.int64)
        np.minimum.at(low, self.index, ids)
        np.maximum.at(high, self.index, ids)
        return low < high

    def crowded(self, most: int) -> np.ndarray:
        """For each different anchor, whether the block has ``most`` stretches of it."""
        return np.bincount(self.index, minlength=len(self.anchors)) >= most

    def by_owner(self) -> Iterator[tuple[int, slice]]:
        return _runs(self.anchors.astype(np.int64) >> 40)

    def shared(self, flags: dict[int, tuple[bytes, bytes]]) -> tuple[Stretches, dict[tuple[int, bytes], int], np.ndarray]:
        """The stretches to ask about, their different contents, and which content each has.

        ``flags`` has, for each owner, the bits of the anchors that are shared, and of those that are crowded.
        """
        shared, crowded = np.zeros(len(self.anchors), bool), np.zeros(len(self.anchors), bool)
        for owner, part in self.by_owner():
            n = part.stop - part.start
            for bits, out in zip(flags[owner], (shared, crowded), strict=True):
                out[part] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        runs = self.runs
        plain = np.flatnonzero((shared & ~crowded)[self.index])
        many = np.flatnonzero((shared & crowded)[self.index])
        pieces = [
            self.texts[t][s : s + n + LENGTH - 1]
            for t, s, n in zip(runs.text[many].tolist(), runs.start[many].tolist(), runs.count[many].tolist(), strict=True)
        ]
        # Equal pieces need finer anchors once only, but every place needs its own.
        finer = stretches(pieces, FINE, self.owners)
        chosen = Stretches(
            np.concatenate([runs.text[plain], runs.text[many][finer.text]]),
            np.concatenate([runs.start[plain], runs.start[many][finer.text] + finer.start]),
            np.concatenate([runs.count[plain], finer.count]),
            np.concatenate([runs.anchor[plain], finer.anchor]),
        )
        known: dict[tuple[int, bytes], int] = {}
        content = np.empty(len(chosen.text), np.int64)
        for k, (t, s, n, anchor) in enumerate(
            zip(chosen.text.tolist(), chosen.start.tolist(), chosen.count.tolist(), chosen.anchor.tolist(), strict=True)
        ):
            content[k] = known.setdefault((anchor, self.texts[t][s : s + n + LENGTH - 1]), len(known))
        return chosen, known, content


# ---- What owners answer -----------------------------------------------------------------


def _flags(table: pa.Table, crowd: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each block of an owner's rows (block, anchors, double, many): bits of its shared and its crowded anchors."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "anchors", "double", "many")), strict=True))
    lists, doubles, manies = [], [], []
    for _, packed, double, many in rows:
        low = np.frombuffer(packed, np.uint8).reshape(-1, 5).astype(np.uint64)
        lists.append((low << (np.uint64(8) * np.arange(5, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
        for bits, kept in ((double, doubles), (many, manies)):
            kept.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(low)).astype(bool))
    values, index, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times > 1
    np.logical_or.at(shared, index, np.concatenate(doubles))
    crowded = times >= crowd
    np.logical_or.at(crowded, index, np.concatenate(manies))
    at = 0
    for (block, *_), values in zip(rows, lists, strict=True):
        own = index[at : at + len(values)]
        at += len(values)
        yield block, np.packbits(shared[own]).tobytes(), np.packbits(crowded[own]).tobytes()


def _eights(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each position on, as one number; symbols beyond the end are 0."""
    padded = np.concatenate((symbols, np.zeros(LENGTH + 8, symbols.dtype))).astype(np.uint64)
    out = np.zeros(len(symbols) + LENGTH, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)] << np.uint64(8 * k)
    return out


def _meeting(symbols: np.ndarray, owner: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` contents may share a window with another of their group: by hashes, so some that share none.

    ``owner`` and ``group`` name the content and its group of every symbol. Windows that run over the end of a content do no harm
    but to be hashed too.
    """
    size = len(symbols) - LENGTH + 1
    out = np.zeros(n, bool)
    if size <= 0:
        return out
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(symbols)), out=sums[1:])
    hashes = (sums[LENGTH:] - sums[:-LENGTH]) * _powers(pow(_BASE, -1, 1 << 64), size)
    hashes = _mixed(hashes + group[:size].astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(hashes)
    ordered, owners = hashes[order], owner[:size][order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    several = np.minimum.reduceat(owners, first) < np.maximum.reduceat(owners, first)
    out[owners[np.repeat(several, np.diff(np.append(first, size)))]] = True
    return out


def first_documents(groups: list[list[tuple[bytes, int]]]) -> list[list[list[tuple[int, int, int]]]]:
    """For each group of (content, doc_id) and each content: runs (first window, end, doc_id) of windows with one smallest doc_id.

    Windows are compared within their group.
    """
    out = [[[(0, len(c) - LENGTH + 1, doc)] for c, doc in group] for group in groups]
    waiting: list[int] = []
    size = 0
    order = sorted((sum(len(c) + 1 for c, _ in group), g) for g, group in enumerate(groups) if len(group) > 1)
    for length, g in order:
        waiting.append(g)
        size += length
        if size >= BATCH_SYMBOLS:
            _by_suffixes(groups, waiting, out)
            waiting, size = [], 0
    if waiting:
        _by_suffixes(groups, waiting, out)
    return out


def _joined(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of contents as symbols of 2 and more, each content followed by a 1, and their sizes with that."""
    sizes = np.array([len(c) + 1 for c in contents], np.int64)
    # UTF-8 has no bytes above 0xF4.
    symbols = np.frombuffer(b"\xff".join([*contents, b""]), np.uint8) + np.uint8(2)
    symbols[np.cumsum(sizes) - 1] = 1
    return symbols, sizes


def _by_suffixes(groups: list, chosen: list[int], out: list) -> None:
    """Set the runs of those contents of the chosen groups that share windows with others of their group."""
    members = np.array([len(groups[g]) for g in chosen], np.int64)
    symbols, sizes = _joined([c for g in chosen for c, _ in groups[g]])
    number = np.repeat(np.arange(len(chosen)), members)
    meets = _meeting(symbols, np.repeat(np.arange(len(sizes)), sizes), np.repeat(number, sizes), len(sizes))
    if not meets.any():
        return
    flat = [(g, k) for g in chosen for k in range(len(groups[g]))]
    kept = [flat[i] for i in np.flatnonzero(meets)]
    number = number[meets]
    contents, docs = [groups[g][k][0] for g, k in kept], np.array([groups[g][k][1] for g, k in kept], np.int64)
    symbols, sizes = _joined(contents)
    ends = np.cumsum(sizes)
    # The contents of a group are a sequence; 1 ends a content, 0 a sequence.
    last = np.flatnonzero(np.append(number[1:] != number[:-1], True))
    symbols[ends[last] - 1] = 0
    lengths = np.diff(np.append(0, ends[last]))
    array = suffix_arrays(symbols, lengths)
    eights = _eights(symbols)
    same = np.ones(len(array) - 1, bool)
    rows = np.arange(len(array) - 1)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal = eights[array[rows + 1] + k] == eights[array[rows] + k]
        same[rows[~equal]] = False
        rows = rows[equal]
    # Sequences do not share runs, though their suffixes may be neighbours.
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    same &= sequence[1:] == sequence[:-1]
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    owner = np.repeat(np.arange(len(contents)), sizes)
    least = np.minimum.reduceat(docs[owner[array]], begins)
    answer = np.empty(len(array), np.int64)
    answer[array] = np.repeat(least, np.diff(np.append(begins, len(array))))
    windows = sizes - LENGTH
    places = spread(ends - sizes, windows)
    owners, values = np.repeat(np.arange(len(contents)), windows), answer[places]
    new = np.ones(len(places), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    start = places[first] - (ends - sizes)[owners[first]]
    runs = list(zip(start.tolist(), (start + np.diff(np.append(first, len(places)))).tolist(), values[first].tolist(), strict=True))
    bounds = np.searchsorted(owners[first], np.arange(len(contents) + 1)).tolist()
    for i, (g, k) in enumerate(kept):
        out[g][k] = runs[bounds[i] : bounds[i + 1]]


def _answers(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """For each block of an owner's questions: (content, from, to, smallest doc_id) where that is news."""
    compressor, reader = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    heads, texts, blocks = [], [], table.column("block").to_pylist()
    for packed in table.column("question").to_pylist():
        heads.append(np.frombuffer(reader.decompress(packed[0]), np.int64).reshape(5, -1))
        texts.append(reader.decompress(packed[1]))
    anchor, content, size, low, high = np.concatenate(heads, axis=1)
    asker = np.repeat(np.arange(len(heads)), [h.shape[1] for h in heads])
    at = np.concatenate([np.cumsum(h[2]) - h[2] for h in heads])
    order = np.argsort(anchor, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(anchor[order]) != 0))) if len(order) else order
    times = np.diff(np.append(first, len(order)))
    # An anchor with a single content of a single block is known there: the first document that has it.
    alone = order[first[times == 1]]
    alone = alone[low[alone] < high[alone]]
    news = [np.stack([asker[alone], content[alone], np.zeros(len(alone), np.int64), size[alone] - LENGTH + 1, low[alone]])]
    groups: list[list[tuple[bytes, int]]] = []
    asking: list[list[list[tuple[int, int, int]]]] = []
    rows = order[np.repeat(times > 1, times)]
    columns = (c[rows].tolist() for c in (anchor, asker, at, size, low, high, content))
    held: dict[bytes, list] = {}
    known = None
    for a, by, start, n, least, most, number in [*zip(*columns, strict=True), (None,) * 7]:
        if a != known:
            if held:
                groups.append([(c, entry[0]) for c, entry in held.items()])
                asking.append([entry[1] for entry in held.values()])
            held, known = {}, a
        if a is not None:
            entry = held.setdefault(texts[by][start : start + n], [LAST_ID, []])
            entry[0] = min(entry[0], least)
            entry[1].append((by, number, most))
    found = []
    for runs_of, askers_of in zip(first_documents(groups), asking, strict=True):
        for runs, askers in zip(runs_of, askers_of, strict=True):
            found += [(by, number, a, b, doc) for a, b, doc in runs for by, number, most in askers if doc < most]
    if found:
        news.append(np.array(found, np.int64).T)
    told = np.concatenate(news, axis=1)
    told = told[:, np.argsort(told[0], kind="stable")]
    bounds = np.searchsorted(told[0], np.arange(len(heads) + 1)).tolist()
    for k, block in enumerate(blocks):
        if bounds[k] < bounds[k + 1]:
            yield block, compressor.compress(np.ascontiguousarray(told[1:, bounds[k] : bounds[k + 1]]).tobytes())


# ---- The jobs ---------------------------------------------------------------------------

MESSAGES = "block long, owner int, shared binary, crowded binary, answer binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SCHEMA = pa.schema(
    [("block", pa.int64()), ("owner", pa.int32()), ("shared", pa.binary()), ("crowded", pa.binary()), ("answer", pa.binary())]
)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^31 as differences, first all first bytes, then all second ones and so on, which compresses well."""
    steps = np.concatenate([np.diff(column, prepend=0) for column in columns]).astype("<i4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(n, -1)
    return np.cumsum(steps, axis=1, dtype=np.int64)


def _flags_of(messages: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    columns = (messages.column(c).to_pylist() for c in ("owner", "shared", "crowded"))
    return {owner: (shared, crowded) for owner, shared, crowded in zip(*columns, strict=True)}


def _answers_to(messages: pa.Table) -> tuple[bytes | None, list[bytes]]:
    """What a block has kept for itself, and the answers of the owners it has asked."""
    kept, answers = None, []
    for owner, answer in zip(messages.column("owner").to_pylist(), messages.column("answer").to_pylist(), strict=True):
        if owner < 0:
            kept = answer
        else:
            answers.append(answer)
    return kept, answers


def remove_repeats(
    docs: DataFrame,
    block_bytes: int = BLOCK_BYTES,
    owner_bytes: int = OWNER_BYTES,
    crowd: int = CROWD,
    crowd_in_block: int = CROWD_IN_BLOCK,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of documents (doc_id, text): the removed runs of bytes, and the rest joined."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, owners = total // block_bytes + 1, total // owner_bytes + 1
    if owners >= 1 << 23:
        raise ValueError("too many owners for anchors of 63 bits: raise owner_bytes")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).alias("block")
    # A bucketed table, so that the three passes over the texts exchange them once.
    path = new_table(spark, "texts")
    name = path.rpartition("/")[2].replace("-", "_")
    files = min(n_blocks, MOST_FILES)
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block)
        .repartition(files, "block")
        .write.bucketBy(files, "block")
        .option("path", path)
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    texts = spark.table(name)
    forget_later(spark, name)

    def announce(table: pa.Table) -> pa.Table:
        own = Block(table, owners)
        double, many = own.in_two_documents(), own.crowded(crowd_in_block)
        number = table.column("block")[0].as_py()
        rows = []
        for owner, part in own.by_owner():
            low = own.anchors[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            bits = [np.packbits(flags[part]).tobytes() for flags in (double, many)]
            rows.append((owner, number, low.tobytes(), *bits))
        schema = [("owner", pa.int32()), ("block", pa.int64())]
        schema += [(name, pa.binary()) for name in ("anchors", "double", "many")]
        return _table(rows, pa.schema(schema))

    def decide(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        return _table([(b, owner, s, c, None) for b, s, c in _flags(table, crowd)], _SCHEMA)

    def ask(table: pa.Table, messages: pa.Table) -> pa.Table:
        rows = []
        if len(table):
            own = Block(table, owners)
            chosen, known, content = own.shared(_flags_of(messages))
            low = np.full(len(known), LAST_ID, np.int64)
            high = np.full(len(known), -LAST_ID - 1, np.int64)
            np.minimum.at(low, content, own.ids[chosen.text])
            np.maximum.at(high, content, own.ids[chosen.text])
            anchors = np.array([a for a, _ in known], np.int64)
            contents = [c for _, c in known]
            sizes = np.array([len(c) for c in contents], np.int64)
            order = np.argsort(anchors, kind="stable")
            compressor = zstandard.ZstdCompressor(level=1)
            number = table.column("block")[0].as_py()
            for owner, run in _runs(anchors[order] >> 40):
                part = order[run]
                head = np.stack([anchors[part], part, sizes[part], low[part], high[part]]).tobytes()
                joined = b"".join([contents[i] for i in part.tolist()])
                packed = [compressor.compress(head), compressor.compress(joined)]
                rows.append((owner, number, packed))
            # What the block needs to place the answers goes to itself, under a number that no owner has.
            rows.append((-1 - number, number, [compressor.compress(_packed(chosen.text, chosen.start, content))]))
        schema = [("owner", pa.int32()), ("block", pa.int64()), ("question", pa.list_(pa.binary()))]
        return _table(rows, pa.schema(schema))

    def answer(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        if owner < 0:
            return _table([(-1 - owner, owner, None, None, table.column("question")[0].as_py()[0])], _SCHEMA)
        return _table([(b, owner, None, None, a) for b, a in _answers(table)], _SCHEMA)

    def cut(table: pa.Table, messages: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_bytes", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("kept", pa.binary()),
            ]
        )
        if not len(table):
            return _table([], schema)
        own = Texts(table)
        reader = zstandard.ZstdDecompressor()
        kept_rows, answers = _answers_to(messages)
        of_text, of_start, content = _unpacked(reader.decompress(kept_rows), 3)
        offsets = np.cumsum([0, *(len(t) + 1 for t in own.texts)])
        change = np.zeros(int(offsets[-1]) + 1, np.int32)
        by_content = np.argsort(content, kind="stable")
        first = np.searchsorted(content[by_content], np.arange(int(content.max(initial=-1)) + 2))
        for packed in answers:
            what, start, end, doc = np.frombuffer(reader.decompress(packed), np.int64).reshape(4, -1)
            times = first[what + 1] - first[what]
            run = by_content[spread(first[what], times)]
            start, end, doc = (np.repeat(c, times) for c in (start, end, doc))
            later = own.ids[of_text[run]] > doc
            place = offsets[of_text[run]] + of_start[run]
            np.add.at(change, (place + start)[later], 1)
            np.add.at(change, (place + end + LENGTH - 1)[later], -1)
        gone = np.cumsum(change) > 0
        rows = []
        for i, text in enumerate(own.texts):
            marks = gone[offsets[i] : offsets[i] + len(text)]
            edges = np.flatnonzero(np.diff(marks.view(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
            kept = np.frombuffer(text, np.uint8)[~marks].tobytes() if edges else text
            rows.append((own.doc_ids[i], len(text), [{"start": a, "end": b} for a, b in edges], kept))
        return _table(rows, schema)

    announced = texts.groupBy("block").applyInArrow(
        announce, "owner int, block long, anchors binary, double binary, many binary"
    )
    flags = cut_lineage(announced.groupBy("owner").applyInArrow(decide, MESSAGES))
    asked = texts.groupBy("block").cogroup(flags.groupBy("block"))
    asked = asked.applyInArrow(ask, "owner int, block long, question array<binary>")
    answers = cut_lineage(asked.groupBy("owner").applyInArrow(answer, MESSAGES))
    everything = texts.groupBy("block").cogroup(answers.groupBy("block"))
    return everything.applyInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
