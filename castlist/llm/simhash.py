"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit for every bit of the hashes of its word shingles, set
where over half of the hashes have it. Documents of one fingerprint are one
row from then on. Fingerprints that differ in at most ``radius`` bits are found so:

* The bits are grouped into parts; bits that correlate on a sample go into the
  same part, so that the parts differ in how much they tell apart.
* ``units`` are dealt out over the parts. A part of u units is probed with
  threshold u - 1: a row is sent to every value of the part that differs from its own in at most u - 1
  bits; a part without units is not probed. With ``units = radius + 1``
  two fingerprints within the radius must meet in some part, for if they differed
  by more than the threshold in every part, they would differ in at least ``units`` bits. With fewer units only those within
  ``units - 1`` bits are found for certain.
* A dynamic programme picks the number of parts and the units of each by the estimated
  cost of probes and candidates; the estimate comes from a sample of ``SAMPLE``
  fingerprints. It decides about cost only, never about the result.
* Rows that meet are compared in full. Of the links among the rows of one value a minimum spanning
  forest is kept, which connects the same rows as all links do, so the links are
  no more than the rows. A value with more than ``CROWD`` rows is dealt out in blocks, and
  each pair of blocks is compared by itself; the forest of the whole is within their forests.

``drop_near_duplicates`` takes documents whose fingerprints link so, if a radius is given, together with those that share
most of their shingles, which it finds exactly.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z become a-z; a text of fewer words than
a shingle has one shingle of all its words; one without words, as a null text, has fingerprint zero, which is
linked like any other. Repeated rows share fingerprint and component. A row without doc_id takes
part only through other rows of its fingerprint. Tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlist.llm.components import components
from castlist.session import cut_lineage, new_table, scratch

SEED = 42
SAMPLE = 1024
CROWD = 8192
SMALL = 8
# Relative cost of sending a row to a value and of comparing two rows there.
ROW_COST, PAIR_COST = 1.0, 0.02
# Near copies: documents sampled for common shingles, this share of them if that is more, and how many shingles are kept: so many,
# or one for so many documents. With a sample of fixed size the shingles it misses would have crowds that grow with the input.
SPREAD, SPREAD_SHARE, COMMON, COMMON_DOCS, MOST_COMMON = 8192, 1 / 32, 1 << 15, 8, 1 << 22
# Up to FEW rows of a shingle are compared pair by pair; more in blocks of so many rows and hashes.
FEW, BLOCK, BLOCK_HASHES, COLUMNS = 8, 256, 1 << 20, 4096
# So many blocks are compared with one in a task; so many rows' ids are broadcast.
TOGETHER, BROADCAST_IDS = 16, 2_000_000
# Parities of a set have a number of places that grows with it, between these.
LEAST_PLACES, MOST_PLACES = 512, 1 << 12
# Of a shingle's hash the first 48 bits travel. Two shingles that share them are taken for one where rows meet, and told
# apart where they are compared.
_TOKEN = np.int64(-1 << 16)

_STRIP = 255 << 8


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=False)]
    return np.array(hashes, np.uint64)


def _planes(hashes: np.ndarray, planes: int) -> Iterator[np.ndarray]:
    """The hashes, and further hashes mixed from them."""
    yield hashes
    for i in range(1, planes):
        x = hashes + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield x ^ (x >> np.uint64(31))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, most significant first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRIP):
        octets = hashes[at : at + _STRIP].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(octets, axis=1)
        # Sums of 255 bits fit a byte.
        whole = len(bits) // 255 * 255
        sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
        counts += sums.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: bytes, size: int, planes: int = 1, distinct: bool = False) -> bytes:
    """64 bits for each plane, most significant first."""
    hashes = shingle_hashes(text, size)
    if distinct:
        hashes = np.unique(hashes)
    return b"".join(
        np.packbits(2 * bit_counts(plane) > len(plane)).tobytes() for plane in _planes(hashes, planes)
    )


def fingerprints(docs: DataFrame, size: int, planes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode(), size, planes, distinct) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp binary")


# ---- The plan: parts, units -------------------------------------------------------------


def bits_of(fps: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
    return np.unpackbits(data, axis=1)


def group_bits(bits: np.ndarray, n_parts: int) -> list[list[int]]:
    """The bits in parts of nearly equal size; each part takes what correlates with its members."""
    width = bits.shape[1]
    centred = bits - bits.mean(axis=0)
    scale = np.maximum(np.sqrt((centred**2).sum(axis=0)), 1e-9)
    related = np.abs(centred.T @ centred) / np.outer(scale, scale)
    np.fill_diagonal(related, 0)
    free, parts = set(range(width)), []
    for i in range(n_parts):
        left = sorted(free)
        members = [left[int(related[np.ix_(left, left)].sum(axis=1).argmax())]]
        affinity = related[members[0]].copy()
        free.remove(members[0])
        while len(members) < (width + i) // n_parts:
            left = sorted(free)
            best = left[int(affinity[left].argmax())]
            members.append(best)
            affinity += related[best]
            free.remove(best)
        parts.append(sorted(members))
    return parts


def near_shares(bits: np.ndarray, most: int) -> np.ndarray:
    """The share of the sample's pairs that differ in at most 0, 1, ... ``most`` bits."""
    n, width = bits.shape
    counts = np.zeros(width + 1)
    signs = bits.astype(np.float32) * 2 - 1
    for at in range(0, n, 512):
        differ = (width - signs[at : at + 512] @ signs.T) / 2
        counts += np.bincount(differ.round().astype(int).ravel(), minlength=width + 1)
    counts[0] -= n
    shares = np.cumsum(counts) / max(n * (n - 1), 1)
    return shares[np.minimum(np.arange(most + 1), width)]


def ball(width: int, threshold: int) -> int:
    return sum(math.comb(width, k) for k in range(threshold + 1))


def allot(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """The units of each part with the least total cost; costs[i][u] is for u units in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for u, more in enumerate(row[: units - used + 1]):
                if used + u not in after or cost + more < after[used + u][0]:
                    after[used + u] = (cost + more, [*taken, u])
        best = after
    return best[units]


def plan(sample: list[bytes], n: int, units: int) -> list[tuple[list[int], int]]:
    """(bits, units) of each part that is probed, the cheapest found for ``n`` fingerprints."""
    bits = bits_of(sample)
    options = []
    for n_parts in sorted({max(1, units // 2), max(1, 3 * units // 4), units}):
        parts = group_bits(bits, n_parts)
        most = -(-units // n_parts) + 1
        costs = []
        for part in parts:
            shares = near_shares(bits[:, part], 2 * most)
            floor = [ball(len(part), 2 * t) / 2.0 ** len(part) for t in range(most)]
            costs.append(
                [0.0]
                + [
                    n * ball(len(part), t) * ROW_COST
                    + n * n / 2 * max(shares[2 * t], floor[t]) * PAIR_COST
                    for t in range(min(most, len(part)))
                ]
            )
        cost, taken = allot(costs, units)
        options.append((cost, [(p, u) for p, u in zip(parts, taken, strict=True) if u]))
    return min(options, key=lambda option: option[0])[1]


# ---- Probing ----------------------------------------------------------------------------


def probe(groups: DataFrame, parts: list[tuple[list[int], int]], carried: int) -> DataFrame:
    """(part, value, id, fp): a row for every value that a fingerprint is sent to, with the first ``carried`` bytes."""
    masks = []
    for part, u in parts:
        flips = [0]
        for k in range(1, u):
            flips += [sum(1 << b for b in c) for c in combinations(range(len(part)), k)]
        masks.append(np.array(flips, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "value", "id", "fp"]
        for whole in batches:
            step = max(1, (1 << 18) // max(len(m) for m in masks))
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                ids, fps = batch.column(0), batch.column(1)
                whole_fps = fps.to_pylist()
                bits = bits_of(whole_fps).astype(np.uint64)
                fps = pa.array([fp[:carried] for fp in whole_fps], pa.binary())
                for i, (part, _) in enumerate(parts):
                    own = (bits[:, part] << np.arange(len(part), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    values = (own[:, None] ^ masks[i]).ravel().view(np.int64)
                    rows = np.repeat(np.arange(len(batch)), len(masks[i]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i, np.int32)), pa.array(values), ids.take(pa.array(rows)), fps.take(pa.array(rows))],
                        names,
                    )

    return groups.select("id", "fp").mapInArrow(run, "part int, value long, id long, fp binary")


def _distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int32)


def forest(words: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """(i, j, distance): a minimum spanning forest of the links within the radius, by Prim's method."""
    n, out = len(words), []
    distance = np.full(n, radius + 1, np.int32)
    parent = np.zeros(n, np.int64)
    waiting = np.ones(n, bool)
    at = 0
    for _ in range(n):
        waiting[at] = False
        distance[at] = np.iinfo(np.int32).max
        d = _distances(words[at], words)
        nearer = waiting & (d < distance)
        distance[nearer] = d[nearer]
        parent[nearer] = at
        nearest = int(distance.argmin())
        if distance[nearest] <= radius:
            out.append((int(parent[nearest]), nearest, int(distance[nearest])))
            at = nearest
        else:
            at = int(waiting.argmax())
            if not waiting[at]:
                break
    return out


def _links_of(ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """Links of complete runs of rows with these sizes; each run holds the rows of one value."""
    out: list[tuple[int, int, int]] = []
    ends = np.cumsum(sizes)
    small = np.repeat(np.where((sizes > 1) & (sizes <= SMALL), ends, 0), sizes)
    rows = np.flatnonzero(small)
    for shift in range(1, SMALL):
        rows = rows[rows + shift < small[rows]]
        if not len(rows):
            break
        d = _distances(words[rows], words[rows + shift])
        for i in np.flatnonzero(d <= radius).tolist():
            out.append((int(ids[rows[i]]), int(ids[rows[i] + shift]), int(d[i])))
    for run in np.flatnonzero(sizes > SMALL).tolist():
        first = int(ends[run] - sizes[run])
        own = words[first : ends[run]]
        # Most crowds are chance meetings without any link.
        if len(own) <= 256 and not (_distances(own[:, None], own[None]) <= radius).sum() > len(own):
            continue
        out += [(int(ids[first + i]), int(ids[first + j]), d) for i, j, d in forest(own, radius)]
    return out


def compare(probes: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b, distance): links among the rows of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(links: list) -> pa.RecordBatch:
            columns = list(zip(*links, strict=True)) or [[]] * 3
            types = [pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "b", "distance"]
            )

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and len(held):
                table = pa.concat_tables([held, table])
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(max(len(table) - 1, 0), bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            edges = np.flatnonzero(change) + 1
            # The last run may go on in the next batch.
            whole = int(edges[-1]) if len(edges) else 0
            held = table.slice(whole).combine_chunks()
            if whole:
                yield emit(_run_links(table.slice(0, whole), edges))
        if held is not None and len(held):
            yield emit(_run_links(held, np.array([len(held)])))

    def _run_links(table: pa.Table, ends: np.ndarray) -> list:
        fps = table.column("fp").to_pylist()
        words = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)
        return _links_of(table.column("id").to_numpy(), words, np.diff(ends, prepend=0), radius)

    near = probes.repartition(*keys).sortWithinPartitions(*keys)
    return near.select(*keys, "id", "fp").mapInArrow(run, "a long, b long, distance int")


def links(groups: DataFrame, radius: int, units: int, compared: int) -> DataFrame:
    """(a, b, distance) of rows (id, fp) with distinct fingerprints: links that connect what lies within the radius.

    Distances are those of the first ``compared`` bytes of the fingerprints.
    """
    groups = groups.where(F.col("id").isNotNull())
    n = groups.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = groups.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = [bytes(row.fp) for row in picked.select("fp").limit(2 * SAMPLE).collect()]
    if not sample:
        return groups.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    probes = probe(groups, plan(sample, n, units), compared)
    keys = ["part", "value"]
    crowds = probes.groupBy(*keys).agg(F.count("*").alias("crowd")).where(F.col("crowd") > CROWD)
    crowds = cut_lineage(crowds)
    if crowds.isEmpty():
        return compare(probes, keys, radius)
    light = probes.join(crowds, keys, "left_anti")
    n_blocks = F.ceil(F.col("crowd") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
    heavy = (
        probes.join(crowds, keys)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )
    return compare(light, keys, radius).unionAll(compare(heavy, [*keys, "low", "high"], radius))


# ---- Documents --------------------------------------------------------------------------


def linked_fingerprints(marks: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of stored rows (doc_id, fp): the smallest doc_id that links of at most ``radius`` bits lead to."""
    groups = cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(groups, radius, radius + 1, 8).select("a", "b"))
    named = groups.join(found, F.col("id") == F.col("node"), "left")
    return named.select("fp", F.coalesce("component", "id").alias("component_id"))


def near_groups(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most ``radius`` bits lead to."""
    marks = cut_lineage(fingerprints(docs, size))
    return marks.join(linked_fingerprints(marks, radius), "fp").select("doc_id", "fp", "component_id")


# ---- Near copies by their shingles --------------------------------------------------------


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes((text or "").encode(), size)).view(np.int64)


def _parities(s: np.ndarray) -> bytes:
    """Whether the hashes that fall on each place, by their last bits, are odd in number; there are about four places for a hash.

    Sets of which these differ in d places differ in at least d hashes. Halves of the places laid over each
    other are the parities for half as many.
    """
    n = min(max(LEAST_PLACES, 1 << (4 * len(s) - 1).bit_length()), MOST_PLACES) if len(s) else LEAST_PLACES
    return np.packbits((np.bincount((s & (n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).tobytes()


def _folded(parity: bytes, size: int) -> np.ndarray:
    """Parities as words of 64 bits, for so many bytes of places."""
    words = np.frombuffer(parity, np.uint64)
    while 8 * len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def may_be_near(distances: np.ndarray, hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with so many hashes together and parities at that distance can be near copies; never a wrong no."""
    return distances * (1 + similarity) <= hashes * (1 - similarity) + 1e-6


def _parity_words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of words for each set, all for the fewest places that any has."""
    rows = column.to_pylist()
    size = min(map(len, rows), default=LEAST_PLACES // 8)
    return np.array([_folded(row, size) for row in rows], np.uint64).reshape(len(rows), size // 8)


def _pair_distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """In how many places the parities of each pair differ, for the fewer places of the two."""
    out = np.zeros(len(left), np.int64)
    pairs = list(zip(left.to_pylist(), right.to_pylist(), strict=True))
    sizes = np.array([min(len(a), len(b)) for a, b in pairs], np.int64)
    for size in np.unique(sizes):
        chosen = np.flatnonzero(sizes == size)
        a, b = (np.array([_folded(pairs[i][k], size) for i in chosen], np.uint64) for k in (0, 1))
        out[chosen] = _distances(a, b)
    return out


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): the distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                sets = [_shingle_set(t.as_py(), size) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, s array<long>")


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that several documents of a sample have, the rarest first."""
    n_docs = docs.count()
    share = min(1.0, max(SPREAD / max(n_docs, 1), SPREAD_SHARE))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    counts = shingle_sets(picked, size).select(F.explode("s").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    several = cut_lineage(counts.where("n > 1"))
    left, kept = min(max(COMMON, n_docs // COMMON_DOCS), MOST_COMMON), F.lit(False)
    for row in several.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():
        # Of the last count that there is room for some are kept.
        part = F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int(min(1.0, left / row.tokens) * (1 << 30))
        kept = (F.col("n") > row.n) | ((F.col("n") == row.n) & part)
        left -= row.tokens
        if left <= 0:
            break
    most = several.where(kept).toArrow()
    token, n = (most.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, -n))[::-1]]


def prefixes(docs: DataFrame, size: int, similarity: float, common: np.ndarray, marked: int | None = None) -> DataFrame:
    """(doc_id, digest, n, parity, prefix, fp): of each shingle set, prefix being n and those of its hashes that a near copy must share one of.

    fp is the fingerprint by shingles of ``marked`` words, if given.

    All sets are in one order: what is not in ``common`` by its hash, then what is, in that order.
    Two sets that share t hashes have the first of these among their first n - t + 1.
    """
    order = np.argsort(common)

    def head(s: np.ndarray) -> np.ndarray:
        length = len(s) - math.ceil(similarity * len(s) - 1e-6) + 1 if len(s) else 0
        if not len(common):
            return s[:length]
        place = np.minimum(np.searchsorted(common, s, sorter=order), len(common) - 1)
        rank = np.where(common[order[place]] == s, order[place] + 1, 0)
        return s[np.argsort(rank, kind="stable")[:length]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                sets = [_shingle_set(t.as_py(), size) for t in some.column(1)]
                columns = [
                    some.column(0),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_parities(s) for s in sets], pa.binary()),
                    pa.array([np.concatenate(([len(s)], head(s) & _TOKEN)) for s in sets], pa.list_(pa.int64())),
                    pa.array([fingerprint((t.as_py() or "").encode(), marked) if marked else None for t in some.column(1)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "parity", "prefix", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, n int, parity binary, prefix array<long>, fp binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right."""
    sides = []
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for sets in (left, right):
        hashes = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(shared, hashes)
        known = np.flatnonzero(shared[np.minimum(place, len(shared) - 1)] == hashes) if len(shared) else place[:0]
        known = known[np.argsort(place[known], kind="stable")]
        sides.append((len(sets), rows[known], place[known]))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), COLUMNS):
        tiles = []
        for n, rows, place in sides:
            a, b = np.searchsorted(place, (at, at + COLUMNS))
            tile = np.zeros((n, min(COLUMNS, len(shared) - at)), np.float32)
            tile[rows[a:b], place[a:b] - at] = 1
            tiles.append(tile)
        out += (tiles[0] @ tiles[1].T).astype(np.int64)
    return out


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of a symmetric matrix that connect what all of its links do, fewer than its rows."""
    waiting, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not waiting[root]:
            continue
        waiting[root], stack = False, [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(near[i] & waiting).tolist()
            waiting[new] = False
            out += [(i, j) for j in new]
            stack += new
    return out


def _sides(table: pa.Table) -> tuple[pa.Table, slice, slice]:
    """The rows of a pair of blocks, the first block's before the other's; a block by itself is both."""
    own, low = table.column("own").to_numpy(), table.column("low").to_numpy()
    table = table.take(pa.array(np.argsort(own != low, kind="stable"))).combine_chunks()
    n_left = int((own == low).sum())
    return table, slice(0, n_left), slice(n_left if n_left < len(own) else 0, len(own))


def _block_hopes(table: pa.Table, similarity: float) -> pa.Table:
    """(low, high, own, id): of rows of a block (high NULL) and of those it is to be compared with, those whose parities leave hope."""
    table = table.combine_chunks()
    own, high = table.column("own").to_numpy(), table.column("high").to_numpy(zero_copy_only=False)
    words, sizes = _parity_words(table.column("parity")), table.column("n").to_numpy().astype(np.int64)
    ids, first = table.column("id").to_numpy(), np.flatnonzero(np.isnan(high))
    low = table.column("low")[0].as_py()
    rows: list[tuple[int, int, int]] = []
    for block in np.unique(own[~np.isnan(high)]).tolist():
        other = np.flatnonzero((own == block) & ~np.isnan(high))
        hope_first, hope_other = np.zeros(len(first), bool), np.zeros(len(other), bool)
        for k, i in enumerate(first):
            near = may_be_near(_distances(words[i], words[other]), sizes[i] + sizes[other], similarity)
            near &= ids[other] != ids[i]
            hope_first[k] = near.any()
            hope_other |= near
        if block == low:
            hope_first[:] = False
        rows += [(block, low, i) for i in ids[first[hope_first]].tolist()]
        rows += [(block, block, i) for i in ids[other[hope_other]].tolist()]
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    names = {"low": pa.array([low] * len(rows), pa.int64())}
    return pa.table(names | {n: pa.array(c, pa.int64()) for n, c in zip(("high", "own", "id"), columns, strict=True)})


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): links that connect the near copies of one block, or those between two blocks."""
    table, first, other = _sides(table)
    ids = table.column("id").to_numpy()
    sets = [s.values.to_numpy() for s in table.column("s")]
    sizes = np.array([len(s) for s in sets], np.int64)
    near = np.zeros((len(sets), len(sets)), bool)
    if first.stop:
        both = overlaps(sets[first], sets[other])
        near[first, other] = both >= similarity * (sizes[first][:, None] + sizes[other][None] - both)
    found = spanning(near | near.T)
    return pa.table(
        {"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())}
    )


def _enough(most_a: str, most_b: str, n_a: str, n_b: str, similarity: float) -> Column:
    """Whether sets of n hashes can be near copies, given how many each has from their first common hash on."""
    return F.least(most_a, most_b) >= F.lit(similarity / (1 + similarity)) * (F.col(n_a) + F.col(n_b)) - 1e-6


def crowd_hopes(crowded: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(low, high, own, id): the rows of each pair of blocks to compare, of rows (token, crowd, id, n, at) of equal token.

    A row's home is the most crowded of its tokens, with the magnitude of n. The rows of a home are dealt out in
    blocks, and two blocks are compared, once, if they have a token in common, at places from which on near copies can still
    share enough, and magnitudes that near copies can have. Rows whose parities rule out every other row there are left out.
    """
    homes = crowded.groupBy("id").agg(F.max(F.struct("crowd", "token")).alias("top"), F.max("n").alias("n"))
    # Sizes of near copies differ by a factor of at most 1 / similarity.
    grade = F.floor(F.log("n") / (math.log(1 / similarity) + 0.01))
    homes = cut_lineage(homes.select("id", F.col("top.token").alias("home"), grade.alias("grade"), F.col("n").cast("long").alias("n")))
    width = homes.groupBy("home", "grade").agg(F.count("*").alias("rows"), F.sum("n").alias("n_all"))
    n_blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("n_all") / BLOCK_HASHES))
    block = F.xxhash64("home", "grade", F.pmod(F.xxhash64("id"), n_blocks))
    placed = cut_lineage(homes.join(width, ["home", "grade"]).select("id", "grade", block.alias("own")))
    # The most hashes that any row of a block has from the token on, and the least that any has at all.
    ends = F.max(F.col("n") - F.col("at")).alias("most"), F.min("n").alias("least")
    spread = cut_lineage(crowded.join(placed, "id").groupBy("token", "grade", "own").agg(*ends))
    pairs = spread.select("token", F.col("own").alias("low"), F.col("grade").alias("g"), F.col("most").alias("most_g"), F.col("least").alias("least_g")).join(
        spread.select("token", F.col("own").alias("high"), F.col("grade").alias("h"), F.col("most").alias("most_h"), F.col("least").alias("least_h")), "token"
    )
    pairs = pairs.where("low <= high and abs(g - h) <= 1").where(_enough("most_g", "most_h", "least_g", "least_h", similarity))
    pairs = pairs.select("low", "high").distinct()
    # A block meets several others in one task, so that its rows are sent once for these.
    width = pairs.groupBy("low").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = cut_lineage(pairs.join(width, "low").select("low", "high", F.pmod(F.xxhash64("high"), F.col("parts")).alias("part")))
    ends = dealt.select("low", "part", "high", F.col("high").alias("own")).unionAll(
        dealt.select("low", "part", F.lit(None).cast("long"), F.col("low").alias("own")).distinct()
    )
    rows = placed.select("id", "own").join(sketches.select(F.col("doc_id").alias("id"), "n", "parity"), "id").join(ends, "own")
    rows = rows.select("low", "part", "high", "own", "id", "n", "parity").groupBy("low", "part")
    return rows.applyInArrow(lambda table: _block_hopes(table, similarity), "low long, high long, own long, id long")


def crowd_links(hopes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect the near copies within each pair of blocks."""
    rows = hopes.join(sets.select(F.col("doc_id").alias("id"), "s"), "id")
    rows = rows.select("low", "high", "own", "id", "s").groupBy("low", "high")
    return rows.applyInArrow(lambda table: _block_links(table, similarity), "a long, b long")


def hopeful(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = _pair_distances(batch.column("pa"), batch.column("pb"))
            near = may_be_near(distances, batch.column("hashes").to_numpy(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("hashes")).mapInArrow(run, "a long, b long")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose documents share that part of their shingles (Jaccard), exactly."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    all_ = F.size("sa") + F.size("sb") - both
    return edges.join(left, "a").join(right, "b").where(both >= similarity * all_).select("a", "b")


def _listed(ids: DataFrame, most: int) -> DataFrame:
    """A stored table of ids, to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def drop_near_duplicates(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int | None = None, marked: int = 3
) -> DataFrame:
    """The documents, all columns, without those that have a near copy with a smaller doc_id.

    Near copies share ``similarity`` of their distinct shingles of ``size`` words or, with a ``radius``, have fingerprints, by
    shingles of ``marked`` words, that differ in at most so many bits (``near_groups``). Chains of
    both kinds are one group. Documents of one shingle set are one row. Every pair of near copies shares one of its rarest
    shingles (``prefixes``); pairs that do are compared by all their shingles, one by one where at most
    ``FEW`` rows share it and otherwise in blocks. The sample of ``common_shingles`` decides which
    shingles are tried, and so the cost, but any order finds every pair. Rows without a doc_id stay; rows of one doc_id are one
    document, and stay or go together.
    """
    spark = docs.sparkSession
    stored = new_table(spark)
    with scratch(spark):
        later = cut_lineage(_later_copies(docs, size, similarity, radius, marked), stored)
    # The columns travel in one, so that no name can clash. Texts stay where they are as long as ids can be sent to them.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kept = rows.join(_listed(later, BROADCAST_IDS), F.col("row.doc_id") == F.col("later"), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _later_copies(docs: DataFrame, size: int, similarity: float, radius: int | None, marked: int) -> DataFrame:
    """(later): the ids of the documents that have a near copy with a smaller one."""
    docs_named = docs.where(F.col("doc_id").isNotNull())
    common = common_shingles(docs_named, size)
    marks = cut_lineage(prefixes(docs_named, size, similarity, common, None if radius is None else marked))
    groups = cut_lineage(marks.groupBy("digest").agg(F.min("doc_id").alias("id")))
    later = marks.select("doc_id", "digest").join(groups, "digest").where("doc_id <> id").select(F.col("doc_id").alias("id"))
    later = cut_lineage(later)
    # Both uses of these rows read the same columns, so that Spark exchanges them once.
    firsts = marks.select("doc_id", "prefix").join(_listed(later, BROADCAST_IDS), F.col("doc_id") == F.col("id"), "left_anti")
    rows = firsts.select(F.col("doc_id").alias("id"), F.get("prefix", F.lit(0)).alias("n"), F.posexplode("prefix").alias("at", "token"))
    rows = rows.where("at > 0").select("token", "id", F.expr("n << 32 | (at - 1)").alias("place"))
    counts = rows.groupBy("token").agg(F.count("*").alias("crowd")).where("crowd > 1")
    met = cut_lineage(rows.join(counts, "token").select(
        "token", "id", F.expr("int(place >> 32)").alias("n"), F.expr("int(place & 4294967295)").alias("at"), "crowd"
    ))
    few = met.where(F.col("crowd") <= FEW).select("token", "id", "n", "at")
    pairs = few.select("token", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "at"))).join(
        few.select("token", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "at"))), "token"
    )
    pairs = pairs.withColumns({f"most_{k}": F.col(f"n_{k}") - F.col(f"at_{k}") for k in "ab"})
    pairs = pairs.where("id_a < id_b").where(_enough("most_a", "most_b", "n_a", "n_b", similarity))
    sketches = marks.select("doc_id", "n", "parity")
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    pairs = cut_lineage(hopeful(pairs, sketches, similarity))
    crowded = met.where(F.col("crowd") > FEW).select("token", "crowd", "id", "n", "at")
    hopes = cut_lineage(crowd_hopes(crowded, sketches, similarity))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(hopes.select("id"))
    ids = cut_lineage(ids.distinct())
    texts = docs_named.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut_lineage(shingle_sets(texts.join(_listed(ids, BROADCAST_IDS), F.col("doc_id") == F.col("id"), "left_semi"), size))
    near = similar(pairs, sets, similarity).unionAll(crowd_links(hopes, sets, similarity))
    if radius is not None:
        # A shingle set belongs with the fingerprints of its documents.
        both = marks.select("digest", "fp").distinct().join(groups, "digest")
        both = both.join(linked_fingerprints(marks.select("doc_id", "fp"), radius), "fp")
        near = near.unionAll(both.select(F.col("id").alias("a"), F.col("component_id").alias("b")).where("a <> b"))
    found = components(near)
    named = groups.join(found, F.col("id") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "id").alias("_first"))
    later = marks.join(named, "digest").where(F.col("doc_id") != F.col("_first"))
    return later.select(F.col("doc_id").alias("later")).distinct()
